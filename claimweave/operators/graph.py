"""Graphs and trees: closures by frontier joins, components by label propagation, cycles by peeling, paths and distances.

Loops hold only distributed tables; each round is written to a table of its own, so that plans stay short and lost
executors cost one round. What the rounds of a walk found is one folder, read as one table however many there were.
Rounds are bounded by the longest shortest path.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only on a local master where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="claimweave-graph-"))
    return sc.getCheckpointDir()


#: Spark deletes the shuffled files of a job when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str, **options: str) -> None:
    """df as a new Parquet folder. What its job shuffled is deleted with it, not when the driver happens to collect its garbage, so that jobs in a row need the disk of the largest, not of all."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEAN, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: it keeps no constraints of the plan before it, which checkpoint() does and which double with each self-join of a loop. It is also computed once, by checkpoint() twice."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    put(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


cut = written


class Rounds:
    """What a loop finds, round by round: a folder with a part for each depth, so that all of it is one scan in a plan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.depth = spark, f"{shared_folder(spark)}/rounds-{uuid4().hex}", -1

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of the next depth, written and read back without it."""
        self.depth += 1
        part, self.schema = f"{self.folder}/depth={self.depth}", df.schema
        put(df, part)
        return self.spark.read.schema(df.schema).parquet(part)

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("depth", IntegerType())])).parquet(self.folder)


def remove(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def closure(start: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, depth): what is reached from start (node) along edges (source, target), not through blocked nodes."""
    rounds, edges = Rounds(start.sparkSession), written(edges.select("source", "target"))
    frontier = rounds.add(start.select("node").distinct())
    while frontier.limit(1).count():
        new = edges.join(frontier.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        if blocked is not None:
            new = new.join(blocked, "node", "left_anti")
        frontier = rounds.add(new.join(rounds.all().select("node"), "node", "left_anti"))
    remove(edges)
    return rounds.all()


def cyclic(edges: DataFrame) -> DataFrame:
    """(source, target) of the edges left when nodes without incoming edges are peeled off again and again: none in a DAG."""
    left = cut(edges.select("source", "target").distinct())
    n = left.count()
    while n:
        last, left = left, cut(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi"))
        remove(last)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node with an edge is connected with."""
    both = cut(edges.select("source", "target").union(edges.select("target", "source")).distinct())
    label = cut(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label, both["target"] == label["node"]).groupBy("source").agg(F.min("root").alias("m"))
        step = cut(label.join(near, label["node"] == near["source"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("mid")))
        jump = step.select(F.col("node").alias("to"), F.col("mid").alias("end"))
        new = cut(step.join(jump, F.col("mid") == F.col("to")).select("node", "was", F.least("mid", "end").alias("root")))
        remove(label, step)
        label = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return label


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, near): the other ends of a node's edges, itself left out."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("near")).union(edges.select(F.col("target").alias("node"), F.col("source").alias("near")))
    return out.where("node <> near").distinct().join(nodes.select("node"), "node", "left_semi")


def touched(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(kind, id): records in or beside a chosen set of nodes: themselves, children, incident edges."""
    a = nodes.join(chosen, "node", "left_semi").select(F.lit("node").alias("kind"), F.col("node").alias("id"))
    b = nodes.join(chosen.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.lit("node").alias("kind"), F.col("node").alias("id"))
    end = lambda c: edges.join(chosen.withColumnRenamed("node", c), c, "left_semi").select(F.lit("edge").alias("kind"), F.col("edge").alias("id"))
    return a.union(b).union(end("source")).union(end("target")).distinct()


def paths(nodes: DataFrame) -> DataFrame:
    """(node, depth, path): nodes (node, parent) of a tree, paths from the root, one join a level."""
    rounds, own = Rounds(nodes.sparkSession), written(nodes.select("node", "parent"))
    level = rounds.add(own.where("parent is null").select("node", F.array("node").alias("path")))
    while level.limit(1).count():
        up = level.select(F.col("node").alias("parent"), "path")
        level = rounds.add(own.join(up, "parent").select("node", F.concat("path", F.array("node")).alias("path")))
    remove(own)
    return rounds.all().select("node", "depth", "path")


def distance_class(mine: Column, my_parent: Column, other: Column, other_parent: Column) -> Column:
    """0 self, 1 descendant, 2 ancestor, 3 sibling, 4 elsewhere: by two joined paths and those of the parents (null at a root)."""
    below = lambda a, b: F.startswith(b, F.concat(a, F.lit("/")))
    return F.when(mine == other, 0).when(below(mine, other), 1).when(below(other, mine), 2).when(my_parent == other_parent, 3).otherwise(4)

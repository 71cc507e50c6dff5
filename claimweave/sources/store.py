"""Stores on disk: a keyed table in hash buckets, of which an upsert rewrites those it touches, and an index of many tables that is swapped in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.operators.graph import cut, put
from claimweave.sources.log import canonical, folders

HOT = ["state", "status", "strength", "queue_name", "kind"]
#: Bytes of JSON of a file of the index.
FILE = 128 << 20
STORED = "id string, part int, at long, json string, " + ", ".join(f"{c} string" for c in HOT) + ", name string"
PLACES, MANIFEST = "name string, part int, before long", "name string, n long, digest decimal(38,0), bytes long"


class KeyedStore:
    """One row a key, as Parquet in ``buckets`` folders by the key's hash. An upsert is one job whose output replaces the buckets it holds when the job commits (dynamic partition overwrite)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, touched: list[int] | None = None) -> DataFrame:
        if not folders(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")

    def upsert(self, rows: DataFrame) -> None:
        """rows (whole, one a key) take the place of those with their key. Buckets without a row among them are not read."""
        new = cut(rows.withColumn("bucket", self.bucket()))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            kept = self.read(touched).join(new.select(self.key), self.key, "left_anti").withColumn("bucket", self.bucket())
            whole = cut(kept.unionByName(new))  # what is read must not be what is written
            whole.repartition("bucket").sortWithinPartitions(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def indexed(df: DataFrame, key: str, hot: dict[str, str], files: int) -> DataFrame:
    """A table's records in the index's shape, in the order of the key: id, part and place in it, canonical JSON, and the columns that lists filter by.

    Rows are dealt once, by ranges of the key and as they are: JSON, much longer than they, is made behind that and goes to the files alone.
    """
    own = [F.col(hot[c]).cast("string").alias(c) if c in hot else F.lit(None).cast("string").alias(c) for c in HOT]
    rows = df.repartitionByRange(files, key).sortWithinPartitions(key)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's number in its task
    return rows.select(F.col(key).cast("string").alias("id"), F.spark_partition_id().alias("part"), at.alias("at"), canonical(*df.columns).alias("json"), *own)


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, digest, bytes): the content of each table, whatever the order of its rows: how many, the sum of their hashes, and how long their JSON is."""
    parts = [df.select(F.lit(name).alias("name"), canonical(*df.columns).alias("json")).select("name", F.xxhash64("json").cast("decimal(38,0)").alias("h"), F.octet_length("json").alias("b")) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    known = every.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("digest"), F.sum("b").alias("bytes"))
    empty = every.sparkSession.createDataFrame([(name,) for name in tables], "name string")
    return empty.join(F.broadcast(known), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit(0).cast("decimal(38,0)")).alias("digest"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


class Index:
    """The records of many tables in one shape, with a manifest of what they were made from, as versions in a folder: a version counts once its manifest, the last thing written, is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> str | None:
        done = [f for f in folders(self.spark, self.folder) if "manifest" in {x.rsplit("/", 1)[1] for x in folders(self.spark, f)}]
        done = [f for f in done if self.spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(f + "/manifest/_SUCCESS"))]
        return max(done, default=None)

    def build(self, tables: dict[str, tuple[DataFrame, str, dict[str, str]]], files: int = 8, most: int = FILE) -> None:
        """tables: name to (rows, key, hot columns). All are staged as one new version, each table in the order of its key in files by ranges of it, and become current together; a build that fails leaves the last version.

        Files of a table are as many as files says, and more where one would hold over ``most`` bytes of JSON on the mean. A row has its place in its file; how many rows stand before a file is written beside them, one row a file.
        """
        last = self.version()
        path = f"{self.folder}/v={int(last.rsplit('=', 1)[1]) + 1 if last else 1:08d}"
        made = digests({name: df for name, (df, _, _) in tables.items()}).collect()  # a row a table
        size = {r["name"]: r["bytes"] for r in made}
        for name, (df, key, hot) in tables.items():
            put(indexed(df, key, hot, max(files, -(-size[name] // most))), f"{path}/rows/name={name}", compression="zstd")
        sizes = self.spark.read.schema(STORED).parquet(f"{path}/rows").groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a file
        before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        put(sizes.select("name", "part", before.alias("before")).coalesce(1), f"{path}/places")
        put(self.spark.createDataFrame(made, MANIFEST).coalesce(1), f"{path}/manifest")

    def read(self) -> DataFrame:
        path = self.version()
        rows = self.spark.read.schema(STORED).parquet(f"{path}/rows")
        places = self.spark.read.schema(PLACES).parquet(f"{path}/places").collect()  # a row a file
        own = rows.join(F.broadcast(self.spark.createDataFrame(places, PLACES)), ["name", "part"])
        return own.select("id", (F.col("before") + F.col("at") + 1).alias("seq"), "json", *HOT, "name")

    def current(self) -> DataFrame:
        """The latest record of each id."""
        rest = [c for c in self.read().columns if c not in ("name", "id")]
        return self.read().groupBy("name", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("name", "id", "r.*")

    def stale(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(name, stale): whether what the index was made from differs from the tables now; tables that it lacks or that are gone are stale."""
        now = digests(tables).select("name", F.col("n").alias("m"), F.col("digest").alias("d"))
        was = self.spark.read.parquet(f"{self.version()}/manifest") if self.version() else self.spark.createDataFrame([], MANIFEST)
        return was.join(now, "name", "full").select("name", (~(F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("d")))).alias("stale"))

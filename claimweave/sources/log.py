"""Append-only logs of JSON lines: numbered reads with corrupt lines located, appends, content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.operators.graph import cut
from claimweave.operators.sizes import small


def read_log(lines: DataFrame, schema: str) -> DataFrame:
    """lines (seq, line) to seq, the schema's columns, corrupt. Blank lines are skipped; a bad line keeps its number."""
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("line") != "").select("seq", parsed.alias("r")).select("seq", "r.*").withColumn("corrupt", F.col("_bad").isNotNull()).drop("_bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a log: a file, or a folder of appends. Numbered from 1 in the order of batches, files and lines, by one row a file split and offsets within it."""
    at = ["_file", "_start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # how far a split's first line is from the first of all: a window over splits alone
    splits = cut(lines.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(splits.select(*at, "_first", before.alias("_before")), F.length("_file") + 32)
    return lines.join(starts, at).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("seq"), "line")


def append(df: DataFrame, path: str, order: list[str]) -> None:
    """Append rows as canonical JSON lines, in this order, as the next batch of a log. Readers see a batch once its job has committed."""
    spark = df.sparkSession
    batches = [int(f.rsplit("=", 1)[1]) for f in folders(spark, path) if "batch=" in f]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(canonical(*df.columns).alias("value")).write.text(f"{path}/batch={max(batches, default=0) + 1:012d}")


def canonical(*columns: str) -> Column:
    """One JSON object with its keys in order; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, none where it does not exist."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in fs.listStatus(own) if f.isDirectory()] if fs.exists(own) else []


def append_new(blobs: DataFrame, store: DataFrame) -> DataFrame:
    """(sha256, bytes) of the blobs that a content-addressed store lacks."""
    return blobs.select(F.sha2("bytes", 256).alias("sha256"), "bytes").dropDuplicates(["sha256"]).join(store.select("sha256"), "sha256", "left_anti")


def write_records(df: DataFrame, path: str, keys: list[str], kind: str = "parquet") -> None:
    """Append in a fixed order of rows; value-identical when rebuilt."""
    df.sortWithinPartitions(*keys).write.mode("append").format(kind).save(path)

"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is broadcast: rows and estimated bytes. A larger side takes the shuffled way.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 48 << 20

_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of our own only on a local master where none is set."""
    global _own_folder
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="claimweave-")
    return "file://" + _own_folder


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame | list[DataFrame]:
    """Write df in the shared folder and read it back: cuts the lineage, and survives lost executors.

    by: a boolean column; the rows where it is true and those where it is false become two tables without it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/claimweave/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    key = "spark.sql.maxConcurrentOutputFileWriters"  # both files of a task are open at once, so no task sorts its rows
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        df.write.partitionBy(by).parquet(path)
    finally:
        spark.conf.set(key, before)
    rest, out = df.drop(by).schema, []
    for value in ("true", "false"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        out.append(spark.read.schema(rest).parquet(f"{path}/{by}={value}") if there else spark.createDataFrame([], rest))
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower()), out.append(name)
    return out


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: Column | None = None, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df is small enough to broadcast, by a count of its rows and of the bytes that row_bytes gives."""
    size = row_bytes if row_bytes is not None else F.lit(64)
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= rows and b <= most_bytes


def fold(column: str) -> Column:
    """crc32 of the id's text, the base of the held-out folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_up() -> None:
    """For tests: remove the folder of our own."""
    global _own_folder
    if _own_folder and os.path.isdir(_own_folder):
        shutil.rmtree(_own_folder, ignore_errors=True)
    _own_folder = None

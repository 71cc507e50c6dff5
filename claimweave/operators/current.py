"""Views of append-only logs: the latest record of an id, its history, first appearances, pages, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.graph import cut


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each id. One aggregation with map-side combining, no sort of the log."""
    own = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*own), seq).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in own])


def first_seen(log: DataFrame, key: str, seq: str) -> DataFrame:
    return log.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n"))


def page(log: DataFrame, seq: str, cursor: int | None, size: int) -> DataFrame:
    """Newest first, strictly older than the cursor where that is known."""
    if cursor is not None and log.where(F.col(seq) == cursor).limit(1).count():
        log = log.where(F.col(seq) < cursor)
    return log.orderBy(F.desc(seq)).limit(size)


def changes(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Records whose value differs from the id's previous one, with that one."""
    w = Window.partitionBy(key).orderBy(seq)
    return log.withColumn("previous", F.lag(value).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Ids that only one side has or whose values differ."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("kind", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def streak(rounds: DataFrame, key: str, seq: str, progressed: Column) -> DataFrame:
    """The longest run of rounds without progress (gaps and islands) and the first round that ended two such."""
    w = Window.partitionBy(key).orderBy(seq)
    marked = rounds.withColumn("_p", progressed.cast("int")).withColumn("_island", F.sum("_p").over(w))
    runs = marked.withColumn("_run", F.sum(1 - F.col("_p")).over(w.partitionBy(key, "_island")))
    return runs.groupBy(key).agg(F.max("_run").alias("longest"), F.min(F.when(F.col("_run") >= 2, F.col(seq))).alias("stopped_at"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with place: 1 for the least key and so on, without a window over the whole table. Parts are dealt by range and kept, then counted."""
    parts = cut(df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # one row a part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")

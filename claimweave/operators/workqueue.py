"""The lease queue in batch: which transitions are legal, what a replay gives, what the sweeps do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEASE_SECONDS, MAX_ATTEMPTS = 900, 3

# fixed values: from, operation, to ("-" is the state before creation)
TRANSITIONS = """
- enqueue queued, - enqueue blocked, - dead_letter dead, blocked unblock queued, queued claim claimed, claimed heartbeat running,
running heartbeat running, claimed release queued, running release queued, claimed expire queued, claimed expire dead, running expire queued,
running expire dead, claimed complete validating, running complete validating, validating validate_pass validated, validating validate_fail failed,
claimed fail failed, running fail failed, validating fail failed, failed retry queued, failed dead_letter dead, validated commit committed,
queued invalidate stale, blocked invalidate stale, validated invalidate stale, stale rebuild queued, stale rebuild blocked, queued cancel cancelled,
blocked cancel cancelled, stale cancel cancelled, failed cancel cancelled, validated cancel cancelled, dead requeue queued
"""


def transitions(spark: SparkSession) -> DataFrame:
    rows = [tuple(x.split()) for x in TRANSITIONS.replace("\n", " ").split(",")]
    return spark.createDataFrame(rows, "from_status string, op string, to_status string")


def illegal(events: DataFrame) -> DataFrame:
    """Events (from_status, op, to_status) that the table lacks. The table is a constant and broadcast."""
    return events.join(F.broadcast(transitions(events.sparkSession)), ["from_status", "op", "to_status"], "left_anti")


def discontinuities(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Events whose from_status is not the item's previous to_status."""
    w = Window.partitionBy(key).orderBy(seq)
    return events.withColumn("previous", F.lag("to_status", 1, "-").over(w)).where(F.col("previous") != F.col("from_status"))


def replayed(events: DataFrame, key: str, seq: str) -> DataFrame:
    claims = F.count(F.when(F.col("op") == "claim", 1))
    return events.groupBy(key).agg(F.max_by("to_status", seq).alias("status"), claims.alias("attempts"), F.count(F.lit(1)).alias("n_events"))


def expired(items: DataFrame, now: str) -> DataFrame:
    """Leased items whose lease ran out: queued again, or dead past the most attempts."""
    late = F.col("status").isin("claimed", "running") & (F.col("leased_at") + F.expr(f"interval {LEASE_SECONDS} seconds") < F.to_timestamp(F.lit(now)))
    more = F.col("attempt") + 1
    return items.where(late).select("item", F.col("status").alias("was"), more.alias("attempt"), F.when(more > MAX_ATTEMPTS, "dead").otherwise("queued").alias("status"))


def unblocked(items: DataFrame, blockers: DataFrame) -> DataFrame:
    """Blocked items all of whose blockers (item, blocker) have ended."""
    ended = items.select(F.col("item").alias("blocker"), F.col("status").isin("committed", "cancelled").alias("ended"))
    waiting = blockers.join(ended, "blocker", "left").where(~F.coalesce("ended", F.lit(False))).select("item")
    return items.where("status = 'blocked'").join(waiting, "item", "left_anti").select("item", F.lit("queued").alias("status"))


def matrix(items: DataFrame, queues: list[str], statuses: list[str]) -> DataFrame:
    """Counts of every queue and status of the closed lists, zeros too."""
    spark = items.sparkSession
    cells = spark.createDataFrame([(q, s) for q in queues for s in statuses], "queue string, status string")
    counts = items.groupBy("queue", "status").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["queue", "status"], "left").fillna(0, "n")

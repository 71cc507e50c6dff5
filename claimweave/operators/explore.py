"""Exploration of threads in rounds under one budget of calls, without running a thread after another.

What a thread would do alone is a fold over its outcomes; which of its calls the budget still pays for follows from their places in the order of all calls (round, then thread), which come from
parts dealt by range and their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.current import numbered
from claimweave.operators.graph import cut


def alone(outcomes: DataFrame, terminal: tuple[str, ...], most_rounds: int = 5, no_progress: int = 2) -> DataFrame:
    """(thread, statuses): the outcomes of the rounds that each thread of (thread, seq, status) runs if nothing stops it: until a terminal one, ``no_progress`` repeats in a row, or the last round."""
    first = outcomes.withColumn("_r", F.row_number().over(Window.partitionBy("thread").orderBy("seq"))).where(F.col("_r") <= most_rounds)
    own = first.groupBy("thread").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "status"))), lambda x: x["status"]).alias("all"))

    def step(s: Column, status: Column) -> Column:
        same = F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), s["got"]), -1) == status, F.lit(False))
        stale = F.when(same, s["stale"] + 1).otherwise(0)
        done = status.isin(*terminal) | (stale >= no_progress)
        on = F.struct(F.concat(s["got"], F.array(status)).alias("got"), stale.alias("stale"), done.alias("done"))
        return F.when(s["done"], s).otherwise(on)

    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(0).alias("stale"), F.lit(False).alias("done"))
    return own.select("thread", F.aggregate("all", start, step)["got"].alias("statuses"))


def explored(outcomes: DataFrame, terminal: tuple[str, ...], budget: int, most_rounds: int = 5, no_progress: int = 2) -> DataFrame:
    """(thread, rounds, status, exhausted): how far each thread comes. The budget pays for the first calls in the order of rounds and, within them, of threads; one it does not pay for ends as 'not_covered'."""
    own = cut(alone(outcomes, terminal, most_rounds, no_progress))
    calls = own.select("thread", F.posexplode("statuses").alias("k", "status")).select("thread", "status", F.struct((F.col("k") + 1).alias("round"), "thread").alias("at"))
    placed = numbered(calls, "at")
    # of a thread's calls the first that is not paid for is its last
    return placed.groupBy("thread").agg(
        F.coalesce(F.min(F.when(F.col("place") > budget, F.col("at.round"))), F.max("at.round")).alias("rounds"),
        F.when(F.bool_or(F.col("place") > budget), "not_covered").otherwise(F.max_by("status", F.col("at.round"))).alias("status"), F.bool_or(F.col("place") > budget).alias("exhausted"))

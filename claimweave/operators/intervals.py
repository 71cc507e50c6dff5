"""Interval joins by equality: bins of several widths, so that each interval lies in two bins at most at its own width, and one bin owns a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(lo: Column, hi: Column, width: int) -> Column:
    """The number of doublings of width that an interval needs to lie in two bins at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2((hi - lo + 1) / F.lit(width)))).cast("int")


def posted(df: DataFrame, prefix: str, lo: str, hi: str, width: int, levels: list[int]) -> DataFrame:
    """df by (level, bin) at its own width and at all coarser ones that are in use."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(prefix), F.col(lo).alias(f"{prefix}_lo"), F.col(hi).alias(f"{prefix}_hi"))
    own = own.withColumn(f"{prefix}_own", level_of(F.col(f"{prefix}_lo"), F.col(f"{prefix}_hi"), width))
    own = own.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda c: c >= F.col(f"{prefix}_own"))))
    bin_of = lambda x: F.floor(F.col(f"{prefix}_{x}") / (F.lit(width).cast("long") * F.pow(F.lit(2.0), F.col("_level"))))
    return own.withColumn(f"{prefix}_first", bin_of("lo")).withColumn("_bin", F.explode(F.sequence(F.col(f"{prefix}_first"), bin_of("hi"))))


def overlapping(left: DataFrame, right: DataFrame, lo: str, hi: str, width: int = 8) -> DataFrame:
    """(l, r): the pairs of rows (as structs) whose closed intervals of whole numbers meet, each once. Intervals with a null end, or that end before they begin, meet nothing.

    width: of the finest bins. A pair meets at the coarser of its two widths, in the bin where the later one begins; long intervals are posted in few wide bins, not in many narrow ones.
    """
    sound = lambda df: df.where(F.col(lo) <= F.col(hi))
    a, b = sound(left), sound(right)
    own = lambda df: df.select(level_of(F.col(lo), F.col(hi), width).alias("n"))
    levels = sorted(r["n"] for r in own(a).union(own(b)).distinct().collect())  # one number a doubling
    if not levels:
        levels = [0]
    pairs = posted(a, "l", lo, hi, width, levels).join(posted(b, "r", lo, hi, width, levels), ["_level", "_bin"])
    mine = (F.col("_level") == F.greatest("l_own", "r_own")) & (F.col("_bin") == F.greatest("l_first", "r_first"))
    return pairs.where(mine & (F.col("l_lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("l_hi"))).select("l", "r")

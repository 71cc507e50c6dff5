"""Rule audits: each rule is a query of its violations (rule, subject); audits are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, rule: str, subject: str, condition: Column) -> DataFrame:
    return df.where(F.coalesce(condition, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def violations(df: DataFrame, subject: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """The violations of several rules over one table, in one pass over it."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(rule)) for rule, condition in rules]))
    return df.select(F.explode(broken).alias("rule"), F.col(subject).cast("string").alias("subject"))


def dangling(df: DataFrame, rule: str, subject: str, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Records whose reference is set and resolves to nothing."""
    return df.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def repeated(df: DataFrame, rule: str, keys: list[str], most: int = 1) -> DataFrame:
    """Keys that occur more often than they may."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("subject"))


def audit(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

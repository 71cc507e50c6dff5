"""As-of joins: each row with the last record of its key before it, without an inequality join.

Both sides become one stream, cut into ranges of time that hold about as many rows each, so that a key with a third of all rows is worked on in as many tasks as it has ranges.
Within a range the last record is carried forward by a window; what was last before a range comes from a table with one row a key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 500_000


def range_of(df: DataFrame, at: str, rows: int = ROWS) -> Column:
    """The number of the range of ``at`` that a row is in. Ranges hold about ``rows`` rows; equal times stay together."""
    n = min(1000, df.count() // rows + 1)
    if n == 1:
        return F.lit(0)
    ends = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000).alias("ends")).first()["ends"]
    return F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(ends or []))]), lambda e: e <= F.col(at)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, inclusive: bool = True, rows: int = ROWS) -> DataFrame:
    """left (with key and at) with ``value`` of the last row of right (key, at, value) of the same key before it; null where there is none.

    inclusive: rows of right at the very time count. Of several rows of right at one time the largest value holds. A null value is a value. Rows of left with a null key or time keep
    their place and meet nothing. Columns of left that are called like the value are replaced.
    """
    own = [c for c in left.columns if c.lower() != value.lower()]
    col = lambda c: F.col(f"`{c}`")
    a = left.select(col(key).alias("_k"), col(at).alias("_at"), F.struct(*map(col, own)).alias("_row"))
    b = right.where(col(key).isNotNull() & col(at).isNotNull()).select(col(key).alias("_k"), col(at).alias("_at"), F.struct(col(value).alias("v")).alias("_new"))
    cut = range_of(b.select("_at").unionByName(a.select("_at")), "_at", rows)
    every = a.withColumn("_side", F.lit(1 if inclusive else -1)).unionByName(b.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_range", cut)
    before = Window.partitionBy("_k", "_range").orderBy("_at", "_side", "_new").rowsBetween(Window.unboundedPreceding, 0)
    inside = every.withColumn("_last", F.last("_new", ignorenulls=True).over(before)).where("_row is not null")
    # one row a key and range: the last record of the range, and with it the record that holds when the next range begins
    last = b.withColumn("_range", cut).groupBy("_k", "_range").agg(F.max(F.struct("_at", "_new")).alias("_m"))
    wanted = inside.where("_last is null and _k is not null").select("_k", "_range").distinct()
    steps = wanted.withColumn("_asks", F.lit(True)).join(last, ["_k", "_range"], "full")
    carried = steps.withColumn("_before", F.last("_m._new", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).where("_asks").select("_k", "_range", "_before")
    found = inside.join(carried, ["_k", "_range"], "left")
    return found.select(*[F.col(f"_row.`{c}`") for c in own], F.coalesce("_last", "_before").getField("v").alias(value))

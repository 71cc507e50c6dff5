"""A brief in a budget of characters: titled sections of lines, filled in order.

A section whose title no longer fits is skipped whole, and later ones may still fit; in an open section the first line that does not fit ends it, and what follows of it is dropped. Some room is
kept back for the note that counts the lines dropped. This is no running sum: what is dropped takes no room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVE, LEAST = 64, 80


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def render(lines: DataFrame, key: str, section: str, seq: str, line: str, sections: list[str], most: int = 8000) -> DataFrame:
    """(key, body, used, dropped): the brief of each key that has lines. Lines go by seq, then by themselves; those of other sections than the listed take no part; a null line is empty.

    A line takes its length and one more, so of each section only the first ``room`` lines can be in: no more than these are gathered for a key, however many it has
    (the limit on the place is applied before the shuffle too); the others are only counted.
    """
    room = max(most - RESERVE, LEAST)
    own = lines.select(F.col(key).alias("key"), F.array_position(F.array(*map(F.lit, sections)), F.col(section)).alias("s"), F.col(seq).alias("seq"), F.coalesce(F.col(line), F.lit("")).alias("line")).where("s > 0")
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("key", "s").orderBy("seq", "line"))).where(F.col("place") <= room)
    counts = own.groupBy("key", "s").agg(F.count(F.lit(1)).alias("n"))
    per = first.groupBy("key", "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines")).join(counts, ["key", "s"])
    per = per.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "n", "lines"))).alias("sections"))
    title = lambda s: F.concat(F.lit("\n## "), F.element_at(F.array(*map(F.lit, sections)), s.cast("int")))
    state = lambda body, used, dropped, is_open: F.struct(body.alias("body"), used.alias("used"), dropped.alias("dropped"), is_open.alias("open"))

    def fill(acc: Column, s: Column) -> Column:
        head = title(s["s"])
        fits = lambda a, t: a["used"] + F.length(t) + 1 <= room
        put = lambda a, t, is_open: state(F.concat(a["body"], F.array(t)), a["used"] + F.length(t) + 1, a["dropped"], is_open)
        into = lambda a, t: F.when(~a["open"], a).when(fits(a, t), put(a, t, F.lit(True))).otherwise(state(a["body"], a["used"], a["dropped"], F.lit(False)))
        filled = F.aggregate(s["lines"], put(acc, head, F.lit(True)), into)
        # lines that came in: what the body has grown by, without the title
        done = lambda f: state(f["body"], f["used"], f["dropped"] + s["n"] - (F.size(f["body"]) - F.size(acc["body"]) - 1), F.lit(True))
        return F.when(fits(acc, head), F.element_at(F.transform(F.array(filled), done), 1)).otherwise(state(acc["body"], acc["used"], acc["dropped"] + s["n"], F.lit(True)))

    start = state(F.array().cast("array<string>"), F.lit(0), F.lit(0).cast("long"), F.lit(True))
    done = per.select("key", F.aggregate("sections", start, fill).alias("f"))
    note = F.when(F.col("f.dropped") > 0, F.array(F.concat(F.lit("\n[truncated: "), F.col("f.dropped"), F.lit(" lines over budget]")))).otherwise(F.array().cast("array<string>"))
    body = F.concat(stripped(F.array_join(F.concat("f.body", note), "\n")), F.lit("\n"))
    return done.select(F.col("key").alias(key), body.alias("body"), F.col("f.used").alias("used"), F.col("f.dropped").alias("dropped"))

"""Topic files: headings of any level with what stands below them, as known sections with their items. Each file is taken apart in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the headings of a topic file in order, without case
SECTIONS = ["topic", "core question", "intended thesis", "paper type", "scope", "exclusions", "seed claims", "known sources", "success criteria"]
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
HEADING, ITEM = r"^(#{1,6})\s+(.*?)\s*$", r"^\s*(?:[-*]|\d+[.)])\s+(.*)$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blocks(text: Column) -> Column:
    """(title, lines) of every heading in order; what stands before the first is dropped."""
    lines = F.split(text, BREAK, -1)
    heads = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(HEADING), F.regexp_extract(x, HEADING, 2)).alias("title"))), lambda h: h["title"].isNotNull())
    upto = lambda ls, hs, k: F.coalesce(F.get(hs, k + 1)["i"], F.size(ls))
    cut = lambda ls, hs: F.transform(hs, lambda h, k: F.struct(h["title"].alias("title"), F.slice(ls, h["i"] + 2, F.greatest(upto(ls, hs, k) - h["i"] - 1, F.lit(0))).alias("lines")))
    # names that lambdas bind, so that lines and headings are found once a file
    own = F.transform(F.array(lines), lambda ls: F.element_at(F.transform(F.array(heads(ls)), lambda hs: cut(ls, hs)), 1))
    return F.element_at(own, 1)


def parsed(files: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, section, items, stray, empty, repeated): the known sections of each file, each once, by its first heading.

    A section with list marks has their items, and counts other lines as stray; one without has its whole text as one item. Unknown headings and their text are passed over.
    """
    rows = files.where(F.col(text_col).isNotNull()).select(F.col(key), F.posexplode(blocks(F.col(text_col))).alias("k", "b")).withColumn("section", F.lower("b.title")).where(F.col("section").isin(*SECTIONS))
    once = rows.groupBy(key, "section").agg(F.min_by("b.lines", "k").alias("lines"), F.count(F.lit(1)).alias("n"))
    items = F.transform(F.filter("lines", lambda x: x.rlike(ITEM)), lambda x: stripped(F.regexp_extract(x, ITEM, 1)))
    body = stripped(F.array_join("lines", "\n"))
    listed = F.size(items) > 0
    stray = F.size(F.filter("lines", lambda x: ~x.rlike(ITEM) & (stripped(x) != "")))
    return once.select(
        key, "section", F.when(listed, items).when(body != "", F.array(body)).otherwise(F.array().cast("array<string>")).alias("items"),
        F.when(listed, stray).otherwise(0).alias("stray"), (body == "").alias("empty"), (F.col("n") > 1).alias("repeated"))


def missing(files: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, missing): the sections that a file lacks, in their order."""
    own = found.groupBy(key).agg(F.collect_set("section").alias("has"))
    want = F.array(*map(F.lit, SECTIONS))
    return files.select(key).distinct().join(own, key, "left").select(key, F.filter(want, lambda x: ~F.coalesce(F.array_contains("has", x), F.lit(False))).alias("missing"))

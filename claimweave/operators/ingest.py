"""Ingest: documents by content, each once, with the bindings of all that brought it, ids in order and citation keys made unique by suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.asof import range_of
from claimweave.operators.current import numbered
from claimweave.operators.graph import cut

ENTRY = "content_hash string, doc_id long, kind string, title string, citation_key string, bindings array<struct<node:long,relation:string,note:string>>"
FIRST = 97  # the letter before the first suffix


def place_in(df: DataFrame, key: str, seq: str) -> DataFrame:
    """df with place: 0, 1, ... by seq within each key. Rows are numbered in ranges of seq and the ranges added up, so that a key with most rows is no single task."""
    own = df.withColumn("_range", range_of(df.select(seq), seq))
    sizes = own.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = own.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_range").orderBy(seq)) - 1)
    return inside.join(before, [key, "_range"]).withColumn("place", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def suffixed(base: Column, place: Column) -> Column:
    """The key itself at 0, then -b, -c and so on by code point (surrogates left out; about 1.1 million in all)."""
    code = place + FIRST + F.when(place + FIRST >= 0xD800, 0x800).otherwise(0)
    return F.when(place == 0, base).otherwise(F.concat(base, F.lit("-"), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")))


def free_place(taken: Column, n: Column) -> Column:
    """The n-th place from 0 that is in none of the runs (first, size) taken, which are in order."""
    return F.aggregate(taken, n.cast("long"), lambda at, run: F.when(run["first"] <= at, at + run["size"]).otherwise(at))


def runs(keys: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, taken): which places of each base are taken by keys (citation_key), as runs of successive ones."""
    whole = keys.select(F.col("citation_key").alias("base"), F.lit(0).cast("long").alias("at"))
    part = keys.where(F.col("citation_key").rlike(r"(?s)^.*-.$")).select(F.expr("left(citation_key, length(citation_key) - 2)").alias("base"), F.hex(F.encode(F.expr("right(citation_key, 1)"), "UTF-32")).alias("h"))
    part = part.select("base", (F.conv("h", 16, 10).cast("long") - FIRST).alias("at")).where("at > 0").select("base", F.when(F.col("at") + FIRST >= 0xE000, F.col("at") - 0x800).otherwise(F.col("at")).alias("at"))
    own = whole.union(part).distinct().join(bases.select("base").distinct(), "base", "left_semi")
    islands = own.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("base").orderBy("at")))
    each = islands.groupBy("base", "island").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    return each.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("first", "size"))).alias("taken"))


def keyed(new: DataFrame, keys: DataFrame) -> DataFrame:
    """new (seq, base, ...) with citation_key: in the order of seq the first free key of each base. keys (citation_key): those given out before.

    A key with a suffix can itself be another's base; where two bases come to one key the earlier row has it, and the later one's base is gone through again from there.
    """
    names = [*new.columns, "citation_key"]
    left, done, given = cut(new), None, keys.select("citation_key")
    while True:
        tried = place_in(left, "base", "seq").join(runs(given, left), "base", "left")
        free = free_place(F.coalesce("taken", F.array().cast("array<struct<first:bigint,size:bigint>>")), F.col("place"))
        tried = cut(tried.withColumn("citation_key", suffixed(F.col("base"), free)))
        winner = tried.groupBy("citation_key").agg(F.min("seq").alias("_seq"))
        lost = tried.join(winner, "citation_key").where("seq <> _seq").groupBy("base").agg(F.min("seq").alias("_from"))
        told = cut(tried.join(lost, "base", "left"))
        sound = told.where("_from is null or seq < _from").select(*names)
        done = sound if done is None else done.union(sound)
        left = cut(told.where("seq >= _from").select(*new.columns))
        if not left.limit(1).count():
            return done
        given = given.union(sound.select("citation_key"))


def ingested(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a store (ENTRY) that a batch (seq, content_hash, kind, title, base, bindings) makes or changes, one a content.

    Content that the store has keeps its entry and gains the bindings (node, relation) that it lacks, at the end; other content becomes an entry of the first row that brought it,
    with the next id. Rows without a content or without bindings are refused. A content that many rows bring is reduced to its distinct bindings before any are gathered.
    """
    rows = batch.where("content_hash is not null and size(bindings) > 0")
    first = rows.groupBy("content_hash").agg(F.min_by(F.struct("seq", "kind", "title", "base"), "seq").alias("f")).select("content_hash", "f.*")
    every = rows.select("content_hash", "seq", F.posexplode("bindings").alias("at", "b"))
    bound = every.groupBy("content_hash", "b.node", "b.relation").agg(F.min(F.struct("seq", "at", "b.note")).alias("m"))
    bound = bound.groupBy("content_hash").agg(F.sort_array(F.collect_list(F.struct("m.seq", "m.at", "node", "relation", "m.note"))).alias("l"))
    listed = F.transform("l", lambda x: F.struct(x["node"].alias("node"), x["relation"].alias("relation"), x["note"].alias("note")))
    new = cut(first.join(bound.select("content_hash", listed.alias("bindings")), "content_hash"))
    known = store.join(new.select("content_hash", F.col("bindings").alias("more")), "content_hash")
    lacks = lambda x: ~F.exists("bindings", lambda y: y["node"].eqNullSafe(x["node"]) & y["relation"].eqNullSafe(x["relation"]))
    known = known.withColumn("bindings", F.concat("bindings", F.filter("more", lacks))).drop("more")
    last = store.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    fresh = keyed(new.join(store.select("content_hash"), "content_hash", "left_anti"), store)
    fresh = numbered(fresh, "seq").withColumn("doc_id", F.col("place") + F.lit(last))
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return known.select(*names).unionByName(fresh.select(*names))

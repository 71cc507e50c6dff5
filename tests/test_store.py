"""Stores, ingest and logs on disk against plain versions."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from claimweave.operators import graph, ingest
from claimweave.operators.ingest import ENTRY, ingested
from claimweave.sources import log
from claimweave.sources.store import Index, KeyedStore, indexed

BATCH = "seq long, content_hash string, kind string, title string, base string, bindings array<struct<node:long,relation:string,note:string>>"


def plain_ingest(store, rows):
    """One row after another on a dictionary by content."""
    for seq, content, kind, title, base, bindings in sorted(rows, key=lambda r: r[0]):
        if content is None or not bindings:
            continue
        if content not in store:
            keys, key, n = {e["key"] for e in store.values()}, base, ord("b")
            while key in keys:
                key, n = f"{base}-{chr(n)}", n + 1
            store[content] = {"id": max((e["id"] for e in store.values()), default=0) + 1, "kind": kind, "title": title, "key": key, "bindings": []}
        own = store[content]["bindings"]
        for b in bindings:
            if (b[0], b[1]) not in {(x[0], x[1]) for x in own}:
                own.append(b)
    return store


def test_ingest(spark, tmp_path, monkeypatch):
    """Batches give what one row after another gives: copies within and across batches, keys that are others' suffixed keys, one base with most rows, refused rows."""
    monkeypatch.setattr(ingest, "range_of", lambda df, at: F.floor(F.col(at) / 7))  # many ranges
    rng = random.Random(12)
    some = lambda: [(rng.randrange(4), rng.choice(["about", "cites", None]), rng.choice([None, "n"])) for _ in range(rng.randrange(4))]
    rows = [(i, rng.choice([None, *[f"h{k}" for k in range(90)]]), "web", f"t{i}", rng.choice(["x", "x", "x", "x-b", "x-c", "x-b-b", "y", ""]), some()) for i in range(160)]
    store = KeyedStore(spark, f"file://{tmp_path}/entries", "content_hash", ENTRY, 4)
    want = {}
    for part in (rows[:60], rows[60:61], [], rows[61:]):
        store.upsert(ingested(store.read(), spark.createDataFrame(part, BATCH)))
        plain_ingest(want, part)
        got = {r["content_hash"]: {"id": r["doc_id"], "kind": r["kind"], "title": r["title"], "key": r["citation_key"], "bindings": [tuple(b) for b in r["bindings"]]} for r in store.read().collect()}
        assert got == want
    assert len({e["key"] for e in want.values()}) == len(want)


def test_suffixes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 25, 26, 200, 0xD7FF - 97, 0xD800 - 97, 70_000)], "n long").select("n", ingest.suffixed(F.lit("k"), F.col("n")).alias("k")).collect()
    point = lambda n: n + 97 + (0x800 if n + 97 >= 0xD800 else 0)
    assert all(r["k"] == ("k" if r["n"] == 0 else f"k-{chr(point(r['n']))}") for r in rows)
    free = spark.createDataFrame([([(0, 1), (3, 2)], n) for n in range(5)] + [([], 3)], "t array<struct<first:bigint,size:bigint>>, n long").select(ingest.free_place(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in free] == [1, 2, 5, 6, 7, 3]


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "k", "k long, v string", 8)
    store.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    before = files()
    store.upsert(spark.createDataFrame([(5, "b"), (500, "c")], "k long, v string"))
    after = files()
    assert len(set(before) & set(after)) >= 6 and {r["k"]: r["v"] for r in store.read().collect()} == {k: "a" for k in range(100)} | {5: "b", 500: "c"}
    store.upsert(spark.createDataFrame([], "k long, v string"))
    assert files() == after


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 0.5), (2, "c", 1.5)], "k long, s string, x double")
    none = rows.where("false")
    index = Index(spark, f"file://{tmp_path}/i")
    assert index.version() is None and {r["name"]: r["stale"] for r in index.stale({"t": rows}).collect()} == {"t": True}
    for _ in range(2):
        index.build({"t": (rows, "k", {"state": "s"}), "none": (none, "k", {})})
    assert index.version().endswith("v=00000002")
    got = sorted((r["id"], r["seq"], r["state"], json.loads(r["json"])["s"]) for r in index.read().collect())
    assert [g[:2] for g in got] == [("1", 1), ("2", 2), ("2", 3)] and all(g[2] == g[3] for g in got)
    assert list(json.loads(index.read().where("id = '2' and state = 'b'").first()["json"])) == ["k", "s", "x"]
    assert {r["id"]: r["seq"] for r in index.current().collect()} == {"1": 1, "2": 3}
    stale = lambda **t: {r["name"]: r["stale"] for r in index.stale(t).collect()}
    assert stale(t=rows.repartition(5), none=none) == {"t": False, "none": False}
    assert stale(t=rows.limit(2), none=rows) == {"t": True, "none": True} and stale(t=rows, more=rows) == {"t": False, "none": True, "more": True}
    (tmp_path / "i" / "v=00000003" / "rows").mkdir(parents=True)  # a build that has not come to its end
    assert index.version().endswith("v=00000002")


def test_log_appends(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(3):
        log.append(spark.range(k * 50, k * 50 + 50).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("a")).repartition(4), path, ["n"])
    lines = log.numbered_lines(spark, path).orderBy("seq").collect()
    assert [(r["seq"], json.loads(r["line"])) for r in lines] == [(i + 1, {"a": None, "n": i}) for i in range(150)]


def test_buckets_grow_with_the_tables(spark, tmp_path):
    index, df = Index(spark, f"file://{tmp_path}/grown"), spark.range(100).selectExpr("id as k", "repeat('x', 100) as t")
    index.build({"a": (df, "k", {})}, files=2, most=2000)
    assert len(index.read().inputFiles()) > 4
    assert index.read().count() == 100
    index.build({"a": (df, "k", {})}, files=2)
    assert len(index.read().inputFiles()) == 2


def test_an_index_needs_little_disk(spark, tmp_path):
    """Rows are dealt as they are, JSON is made behind that; beside the index no table is left, and what a job shuffled goes with it."""
    df = spark.range(3000).selectExpr("id % 1000 as k", "cast(id as string) as s")
    plan = indexed(df, "k", {}, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and " AS json#" in plan.split("Exchange")[0] and " AS json#" not in plan.split("Exchange")[1]
    tables = lambda: set(os.listdir(graph.shared_folder(spark).removeprefix("file:")))
    shuffled = lambda: sum(str(f).startswith("shuffle_") for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split())
    here, before = tables(), shuffled()
    index = Index(spark, f"file://{tmp_path}/disk")
    index.build({"a": (df, "k", {"state": "s"})}, files=3)
    for _ in range(50):
        if shuffled() > before + 8:  # the digest's own, some small files
            time.sleep(0.1)
    assert tables() == here and shuffled() <= before + 8
    got = sorted((r["seq"], int(r["id"])) for r in index.read().collect())
    assert got == [(i + 1, i // 3) for i in range(3000)]

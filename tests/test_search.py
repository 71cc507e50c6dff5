"""Substring search and best matches against all pairs, and with a token that all rows share."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.operators import cluster, provenance, retrieve, substrings


def test_holding(spark):
    """Quotes of one word, parts of words, Chinese ones, with and without blanks; repeated texts; a very long text; quotes shorter than a gram."""
    rng = random.Random(2)
    alphabet = "ab漢字😀 é"
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(120)] + [(200, "ab" * 3000 + "字漢"), (201, None), (202, ""), (203, "aaa"), (203, "aaa"), (204, "a rate of 92% was seen in the end")]
    quotes = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(80)} | {"字", "漢字", "aa", "aaa", "aaaa", "rate of 92% was", "ate of 92% wa", "zzz", "b字漢", "seen in", "%"}
    bodies = spark.createDataFrame(docs, "doc long, body string").repartition(3)
    asked = spark.createDataFrame([(q,) for q in [*quotes, "", None]], "quote string")
    got = substrings.holding(asked, bodies)
    assert sorted(tuple(r) for r in got.collect()) == sorted({(q, i) for q in quotes if q for i, t in docs if t and q in t})
    for df in (got, substrings.by_grams(asked.where("quote <> ''"), bodies)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substrings.holding(asked.where("false"), bodies).count() == 0 and substrings.holding(asked, bodies.where("false")).count() == 0


def test_grams_of_batches(spark):
    """Runs of one to three characters, of any plane, as numbers; and no row for each place of a text."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\x00é漢😀 ") for _ in range(rng.randrange(40))) for _ in range(50)] + ["", "ab" * 2000]
    asked = sorted({"a", "é漢", "b\x00a", "😀 b", "aba", "zz", "bab"})
    of = {int(substrings.codes(substrings.characters([g])[0][:-1], len(g))[0]): g for g in asked}
    grams = np.array(sorted(of), dtype="int64")
    assert len(of) == len(asked)
    got = {(i, of[int(grams[g])]) for i, g in zip(*substrings.met(texts, grams, [1, 2, 3]), strict=True)}
    assert got == {(i, g) for i, t in enumerate(texts) for g in asked if g in t}
    df = substrings.by_grams(spark.createDataFrame([("aba",), ("bab",)], "quote string"), spark.createDataFrame(list(enumerate(texts)), "doc long, body string"))
    assert {tuple(r) for r in df.collect()} == {(g, i) for i, t in enumerate(texts) for g in ("aba", "bab") if g in t}
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def plain_best(claims, units, k, least, fits=lambda c, u: True):
    out = []
    for c in claims:
        a = set((c[1] or "").split())
        scores = sorted((-len(a & set((u[1] or "").split())), u[0]) for u in units if fits(c, u))
        out += [(c[0], i, -s, p + 1) for p, (s, i) in enumerate([x for x in scores if -x[0] >= least][:k])]
    return sorted(out)


def test_best_matches(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(["the", "of"][: rng.randrange(3)] + [words[min(59, int(rng.expovariate(0.08)))] for _ in range(n)])
    claims = [(i, some(rng.randrange(12)), rng.choice("xyz")) for i in range(25)] + [(90, None, "x"), (91, "the of", "x"), (92, "unheard of", "y"), (93, "", "x")]
    units = [(i, some(rng.randrange(20)), rng.choice("xyz")) for i in range(300)] + [(900, None, "x"), (901, "", None)]
    a, b = spark.createDataFrame(claims, "claim long, text string, lane string"), spark.createDataFrame(units, "unit long, text string, lane string").repartition(4)
    for k, least, seeds in ((12, 2, 500), (3, 1, 5), (2, 4, 1), (400, 2, 20)):
        got = sorted(tuple(r) for r in retrieve.best_matches(a, b, k, least, seeds=seeds).collect())
        assert got == plain_best(claims, units, k, least), (k, least)
    got = sorted(tuple(r) for r in retrieve.best_matches(a, b, 5, 2, F.col("lane") == F.col("u_lane"), seeds=10).collect())
    assert got == plain_best(claims, units, 5, 2, lambda c, u: c[2] == u[2])
    assert retrieve.best_matches(a.where("false"), b).count() == 0 and retrieve.best_matches(a, b.where("false")).count() == 0


def test_texts_are_taken_apart_once(spark):
    """Few units meet the condition, and those with low scores, so that it is asked of more and more pairs; what is returned reads no text again."""
    claims = [(i, f"a b c d e f{i}", i % 3) for i in range(4)]
    units = [(i, " ".join(["a", "b", "c", "d", "e"][: 2 + i % 4]), 0 if i % 4 else 1 + i % 97) for i in range(400)]
    a, b = spark.createDataFrame(claims, "claim long, text string, lane long"), spark.createDataFrame(units, "unit long, text string, lane long")
    got = retrieve.best_matches(a, b, 5, 2, F.col("lane") == F.col("u_lane"), seeds=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_best(claims, units, 5, 2, lambda c, u: c[2] == u[2])
    for df in (got, retrieve.best_matches(a, b, 5)):
        assert "regexp_extract_all" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_token_of_all_rows(spark):
    """100,000 rows that share one token: no row is lost, and the token brings no pairs together."""
    rows = spark.range(100_000).select(F.col("id").alias("unit"), F.concat(F.lit("common n"), F.col("id"), F.lit(" m"), F.col("id") % 50_000).alias("text"))
    claims = spark.range(200).select(F.col("id").alias("claim"), F.concat(F.lit("common n"), F.col("id"), F.lit(" m"), F.col("id") % 50_000).alias("text"))
    got = {(r["claim"], r["unit"]): r["score"] for r in retrieve.best_matches(claims, rows).collect()}
    assert got == {(i, i): 3 for i in range(200)} | {(i, i + 50_000): 2 for i in range(200)}
    assert cluster.similar_sets(rows.select(F.col("unit").alias("id"), F.split("text", " ").alias("words")), 0.8).count() == 0


def test_evidence(spark):
    found = spark.createDataFrame([(1, 0, None, "the first lines"), (1, 1, "a", "the second lines"), (1, 2, "b", "the third lines"), (1, 3, "a", "the fourth lines"), (2, 0, None, "the only line")], "d int, ord int, locator string, text string")
    asks = [(1, "second  lines"), (1, "lines"), (1, "first"), (1, "fourth"), (2, "only"), (3, "x"), (1, None), (1, "lines")]
    got = [tuple(r) for r in provenance.evidence(spark.createDataFrame(asks, "d int, quote string"), found, "d").collect()]
    want = [(1, "second  lines", "a", 1, True), (1, "lines", "a", 1, True), (1, "first", "unaddressable", None, False), (1, "fourth", "a", 3, False), (2, "only", "unaddressable", None, False), (3, "x", "unaddressable", None, False), (1, None, "unaddressable", None, False), (1, "lines", "a", 1, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_vector_searches_against_pairs(spark):
    """Ties, copies, null labels and components, and vectors of other lengths: searches by blocks agree with all pairs."""
    from claimweave.operators import retrieve, vectors

    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)], rng.choice([1, 2, 3, None])) for i in range(90)] + [(90, [1.0, 0.0], 1), (91, [1.0, None, 0.0, 1.0], 1), (92, [0.0] * 4, 2)]
    e = spark.createDataFrame(rows, "v long, b array<double>, vl int")
    q = e.where("v % 10 = 0").selectExpr("v as q", "b as a", "vl as ql")
    slow = retrieve.by_blocks(q, "q", e, "v").where("q <> v").withColumn("cos", retrieve.cosine(F.col("a"), F.col("b"))).withColumn("same", F.coalesce(F.col("ql") == F.col("vl"), F.lit(False))).select(*"q v cos same ql vl".split()).cache()
    got = lambda df: sorted(map(repr, df.select("q", "v", "cos").collect()))
    assert got(vectors.pairs(q, e, 32)) == got(slow)
    for k, kind, keep in ((8, "any", "true"), (3, "other", "ql <> vl"), (1, "same", "ql = vl")):
        assert got(retrieve.top_k(vectors.best(q, e, k, kind, block=32), "q", "cos", "v", k)) == got(retrieve.top_k(slow.where(keep), "q", "cos", "v", k))
    ranked = slow.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "v")))
    want = retrieve.recall(ranked, "q", F.col("same"), slow.groupBy("q").agg(F.count(F.when(F.col("same"), 1)).alias("relevant")), 8)
    assert vectors.recall(q, e, 8).collect() == want.collect()
    assert "aggregate(" not in vectors.pairs(q, e)._jdf.queryExecution().optimizedPlan().toString()

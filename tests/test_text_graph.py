"""Text gates on two-sided cases, exact URLs, near duplicates, components and closures against brute force, logs."""

import random

from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import cluster, graph, retrieve
from claimweave.sources import log


def test_exact_urls():
    cases = {
        "HTTP://www.Example.com:80//a//b/?utm_source=x&b=2&ref=q#top": "http://example.com/a/b?b=2", "example.com/x/": "https://example.com/x", "https://e.org:8443/": "https://e.org:8443/", "http://e.org:8o8/p": "http://e.org:8o8/p", "": None, None: None,
    }
    assert {k: text_udf.exact_url(k) for k in cases} == cases


def test_polarity_both_ways():
    assert text_udf.polarity("92%", "It never failed; it reached 92%.") == "pass"
    assert text_udf.polarity("92%", "It did not, in that year, reach 92%.") == "pass"  # another clause
    assert text_udf.polarity("not 92%", "It was not 92% there.") == "pass"  # the payload has the operator


def brute_near(rows, threshold, size):
    import re

    sets = {i: ({t[k : k + size] for k in range(len(t) - size + 1)}, sorted(re.findall(r"\d+(?:\.\d+)?", t))) for i, t in rows}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] and sets[b][0] and sets[a][1] == sets[b][1]:
                j = len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0])
                if j >= threshold:
                    out.add((a, b))
    return out


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "CASP14", "CASP15", "score", "é"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join([*base, "one"])))
        rows.append((3 * i + 2, " ".join(base).replace("CASP14", "CASP16")))
    got = {(r["a"], r["b"]) for r in cluster.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == brute_near(rows, 0.82, 5) and got


def test_contained_without_inner_words(spark):
    docs = [(1, "A wonderful day, seen  from the\nhill-tops"), (2, "准确率达到了92%。其余不变"), (3, "wonder alone"), (4, "the hill"), (5, None), (6, "")]
    quotes = ["wonder", "率达到", "ful day, seen from the hill", "the hill", "day, seen", "from the hi", "...", "a - hill", " ", None, "wonder", "seen from th", "hill"]
    squeezed = {i: " ".join((t or "").split()) for i, t in docs}
    want = sorted((k, i) for k, q in enumerate(quotes) for i, t in squeezed.items() if q and q.strip() and " ".join(q.split()) in t)
    got = retrieve.contained(spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == want and want


def test_components_and_closure(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "source long, target long")
    assert {r["node"]: r["root"] for r in graph.components(edges.where("source <> target")).collect()} == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    reach, todo = {5}, [5]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in reach:
                reach.add(b), todo.append(b)
    assert {r["node"] for r in graph.closure(spark.createDataFrame([(5,)], "node long"), edges).collect()} == reach


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "source long, target long")
    assert {(r["source"], r["target"]) for r in graph.cyclic(edges).collect()} >= {(1, 2), (2, 3), (3, 1)}
    assert graph.cyclic(edges.where("source <> 3")).count() == 0


def test_log_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": oops\n{"a": 3}\n')
    lines = log.numbered_lines(spark, str(tmp_path / "l.jsonl"))
    got = {r["seq"]: (r["a"], r["corrupt"]) for r in log.read_log(lines, "a long").collect()}
    assert got == {1: (1, False), 3: (None, True), 4: (3, False)}


def test_append_new(spark):
    blobs = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "bytes binary")
    store = blobs.where(F.col("bytes") == b"y").select(F.sha2("bytes", 256).alias("sha256"))
    assert [bytes(r["bytes"]) for r in log.append_new(blobs, store).collect()] == [b"x"]


def test_passage_terms(spark):
    row = spark.sql("select 'The Networks were trained, 92.4% of it' as t").select(text.passage_terms(F.col("t")).alias("x")).first()
    assert row["x"] == ["network", "train", "92.4%"] or "train" in row["x"]


def test_plans_of_loops_do_not_grow_with_depth(spark):
    chain = spark.range(14).selectExpr("id as node", "case when id > 0 then id - 1 end as parent")
    paths = graph.paths(chain)
    assert {r["node"]: (r["depth"], r["path"]) for r in paths.collect()} == {i: (i, list(range(i + 1))) for i in range(14)}
    reached = graph.closure(spark.createDataFrame([(13,)], "node long"), chain.where("parent is not null").selectExpr("node as source", "parent as target"))
    assert {r["node"]: r["depth"] for r in reached.collect()} == {i: 13 - i for i in range(14)}
    for df in (paths, reached):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "Join" not in plan


def test_polarity_compiles_no_pattern_for_a_row(monkeypatch):
    def compiled(pattern, flags=0):
        raise AssertionError(pattern)

    monkeypatch.setattr(text_udf.re, "escape", compiled)
    assert text_udf.polarity("92%", "在无噪声情况下达到92%。") == "NEG-S,NEG-C"
    assert text_udf.polarity("92%", "It did not reach 92% on the set.") == "NEG-S"

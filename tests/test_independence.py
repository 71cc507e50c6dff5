"""Clusters of sources: the published cases, and forests against a plain union of links in order."""

import random

from claimweave.operators import independence

SCHEMA = "id long, object_sha256 string, anchor string, doi string, arxiv_id string, work_id string, title string, authors array<string>, cites_source_id long, upstream_id string, self_cite_group string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def judged(spark, rows):
    """(clusters, candidates, rules of the log) of references given as dictionaries."""
    df = spark.createDataFrame([tuple({"id": i, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)], SCHEMA)
    log = independence.forest(independence.links(df))
    roots = independence.clusters(df, log)
    return roots.select("root").distinct().count(), independence.candidates(df, roots).select("a", "b").distinct().count(), sorted((r["rule"], r["level"]) for r in independence.named(log).collect())


def test_cases(spark):
    said = "We evaluate on the CASP14 benchmark using standard protocols."
    assert judged(spark, [{"upstream_id": "nikkei"} for _ in range(11)])[:2] == (1, 0)
    title = {"title": "Highly accurate protein structure prediction", "authors": ["Jumper"]}
    assert judged(spark, [{"arxiv_id": "2101.1v1", **title}, {"arxiv_id": "2101.1v3", **title}, {"doi": "10.1/x", **title}]) == (1, 0, [("exact-id", "exact"), ("same-title-first-author", "exact")])
    assert judged(spark, [{"doi": f"10.1/{i}", "authors": [f"a{i}"], "title": f"own title {i} {i}"} for i in range(3)])[:2] == (3, 0)
    near = "protein structure prediction with deep networks today"
    assert judged(spark, [{"doi": "1", "title": near, "authors": ["a"]}, {"doi": "2", "title": near + " again", "authors": ["b"]}])[:2] == (2, 1)
    assert judged(spark, [{"doi": "1", "title": near, "authors": ["a"]}, {"doi": "2", "title": near, "authors": ["b"]}])[:2] == (2, 1)
    assert judged(spark, [{"anchor": said}, {"anchor": said.replace("using", "now using")}])[2] == [("near-duplicate", "near")]
    assert judged(spark, [{"anchor": said}, {"anchor": said.replace("CASP14", "CASP15")}])[0] == 2
    assert judged(spark, [{"doi": "1", "anchor": "The market was worth $2558 million in all."}, {"doi": "2", "anchor": "Analysts put the total at $2558 by their own count of firms."}])[:2] == (2, 1)
    assert judged(spark, [{"doi": "1", "anchor": "It gained 100 points in 2019."}, {"doi": "2", "anchor": "In 2019 a hundred others had 100 of these things."}])[:2] == (2, 0)
    assert judged(spark, [{"object_sha256": "x", "doi": "1"}, {"object_sha256": "x", "doi": "1"}])[2] == [("same-content-sha256", "exact")]  # the first rule is named
    assert judged(spark, [{"cites_source_id": 1}, {"cites_source_id": 1}, {"cites_source_id": 99}])[2] == [("citation-chain", "exact")]
    assert judged(spark, [{"doi": "1", "authors": ["x y", "z"], "title": "one thing"}, {"doi": "2", "authors": ["Z", "X  Y"], "title": "another matter"}])[:2] == (2, 1)
    assert judged(spark, [{}, {}])[:2] == (2, 0) and judged(spark, []) == (0, 0, [])


def test_forest(spark):
    """The forest is that of taking all links in order and keeping those that join something; long chains take few rounds."""
    rng = random.Random(8)
    edges = {(rng.randrange(7), *sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(2, 100 + i, 101 + i) for i in range(40)} | {(3, 5, 5 + 100)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = []
    for rule, a, b in sorted(edges):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            want.append((rule, a, b))
    got = independence.forest(spark.createDataFrame(list(edges), "rule int, source long, target long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_tables_left(spark, tmp_path, monkeypatch):
    """Of a run's tables only the log's rounds, the last labels and the (empty) last links stay in the shared folder."""
    from claimweave.operators import graph

    monkeypatch.setattr(graph, "shared_folder", lambda _: f"file://{tmp_path}")
    log, roots = independence.grown(spark.createDataFrame([(2, i, i + 1) for i in range(30)] + [(3, 50, 51), (1, 51, 52)], "rule int, source long, target long"))
    assert log.count() == 32 and sorted({r["root"] for r in roots.collect()}) == [0, 50]
    rounds = len(log.inputFiles()) and len({f.rsplit("/", 1)[0] for f in log.inputFiles()})
    assert len(list(tmp_path.glob("table-*"))) == rounds + 2
    assert independence.grown(spark.createDataFrame([], "rule int, source long, target long")) == (None, None)

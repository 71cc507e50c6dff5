"""The queries of the package against their SQL, and the pipeline stage by stage."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import queries as llm
from claimweave.llm.toxicity import FactorizationMachine
from tests.llm.test_operators import brute_hits, brute_roots
from tests.support import SF, duck, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    assert spark_rows(llm.queries()[name](spark, SF)) == duck_rows(duck(), llm.oracle_sql()[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.where("length(text) > 0").select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == last.count()


def test_stages_against_plain_versions(spark):
    """Each filtering stage on odd rows (null and repeated ids, null and empty texts, copies, noise): what it keeps, by id and text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    prose = docs.where("length(text) > 400").orderBy("doc_id").first()["text"]
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzwkjvğωжю") for _ in range(9)) for _ in range(200))
    more = [(None, None), (None, ""), (None, prose + " tail"), (None, noise), (-5, prose + " one more"), (-5, noise), (-6, bench[0][1]), (-7, "word " * 300 + bench[1][1]), (-8, "12 34 56"), (-9, bench[0][1] + " " + "own words here " * 400)]
    rows = docs.union(spark.createDataFrame([(i, t, None, None, None) for i, t in more], docs.schema))
    every = [(r["doc_id"], r["text"]) for r in rows.collect()]
    kept = lambda name: sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)[name](spark, rows, SF).collect()), key=str)
    # toxicity and language: by the models' scores of the same rows
    from claimweave.llm.common import fold
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = FactorizationMachine().fit(llm.labelled(rows.where(fold("doc_id") % 5 != 0).select("doc_id", "text"), labels.select("doc_id", "toxic")))
    assert kept("toxicity") == sorted(((r["doc_id"], r["text"]) for r in model.predict(rows).collect() if r["score"] < 0.5), key=str)
    words = lambda t: re.findall(r"[^\W\d_]", t or "")
    assert kept("language") == sorted((x for x in every if words(x[1]) and x[1] != noise), key=str)
    # near duplicates: one row of each component, the smallest id, documents without words all stay
    got = kept("near_duplicates")
    members = defaultdict(list)
    for (i, t), root in zip(every, brute_roots(every, 80, 100, 5), strict=True):
        members[root].append((i, t))
    plain = [x for m in members.values() for x in (m if not (m[0][1] or "").split() else [min(m, key=lambda x: (x[0] is None, x[0] or 0))])]
    assert sorted((str(i) for i, _ in got)) == sorted(str(i) for i, _ in plain) and set(got) <= set(every)
    # decontamination: by windows, found one by one
    dirty = Counter((d, n, k, ids) for d, n, k, _, ids, bad in brute_hits(every, bench) if not bad)
    assert len(kept("decontamination")) == dirty.total()
    assert {(-6, bench[0][1])}.isdisjoint(kept("decontamination")) and (-9, bench[0][1] + " " + "own words here " * 400) in kept("decontamination")


def test_language_without_profiles(spark):
    """Without any language to learn from, all documents with letters stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

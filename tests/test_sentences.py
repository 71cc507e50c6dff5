"""Periods, scopes, quotes, numbers and sentences on two-sided cases; interval joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import intervals


def test_quotes_and_numbers(spark):
    quotes = [("深度学习 方法", "我们提出的 深度学习方法 有效", True), ("the “best” score", 'It has the "best"  score here', True), ("a–b", "range a-b seen", True), ("missing words", "nothing here", False), ("wait…", "please wait...", True), ("Case", "case differs", False), ("AlphaFold 预测", "AlphaFold预测结果", True), ("a b", "a\tb", True), (None, "x", None)]
    got = spark.createDataFrame(quotes, "q string, s string, want boolean").select(text.quote_faithful(F.col("q"), F.col("s")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    numbers = [("rate of 36% seen", "3", False), ("rate of 36% seen", "36", True), ("about 1,200 cases", "200", False), ("in 92.4 points", "92", False), ("score 92.4.", "92.4", True), ("no digits at all", "digits", True), ("x7y", "7", True), ("5 of 15", "5", True), ("a+b=3", "b=3", True), ("10", "10", True)]
    got = spark.createDataFrame(numbers, "h string, n string, want boolean").select(text.number_at_border(F.col("h"), F.col("n")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    forms = {"thirty-six percent": "36%", "twenty one of ninety": "21 of 90", "７３．５５％": "73.55%", "三十六个百分点": "36%", "10 – 8 units": "10-8 units", "p − 5": "p - 5", "十二": "12", "39 per cent": "39%", "no numbers": "no numbers", "Seventeen  tests": "17 tests"}
    assert {k: text_udf.numeric_form(k) for k in forms} == forms


def test_periods_and_scopes(spark):
    years = {"2019": (2019, 2019), " 2001–2005 ": (2001, 2005), "2005 ～ 2001": (2001, 2005), "2001‑2003": (2001, 2003), "the 1990s": None, "early": None, "19999": None, None: None, "2001--2003": None}
    got = spark.createDataFrame([(k,) for k in years], "p string").select("p", text.year_range(F.col("p")).alias("y")).collect()
    assert {r["p"]: r["y"] and tuple(r["y"]) for r in got} == years
    scopes = [("2019", "2018-2020", "EU", "eu", "a,b", "B", True), ("2001", "2006", None, None, "", "", False), (None, "2006", "US", "CN", "a", "a", False), (None, None, None, "CN", "a", "b", False), ("1990s", "the 1990s", "X", "x", None, "b", True), ("2010-2012", "2012-2015", "X", None, "A,C", "c,d", True)]
    some = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = spark.createDataFrame(scopes, "p1 string, p2 string, r1 string, r2 string, a1 string, a2 string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.select("want", text.scope_compatible(*[F.col(c) for c in ("p1", "p2", "r1", "r2")], some("a1"), some("a2")).alias("got")).collect())


def test_containing_sentence(spark):
    body = "One. It rose 3.5 points. 然后停止。Then v.2 came.\nLast one"
    cases = [("rose", "It rose 3.5 points."), ("5 points.", "It rose 3.5 points."), ("One.", "One."), ("One", "One."), ("停止。", "然后停止。"), ("Then", "Then v."), ("2 came", "2 came."), ("Last", "Last one"), ("absent", "absent"), ("points. 然后", "It rose 3.5 points. 然后停止。"), ("3.", "It rose 3.5 points.")]
    got = spark.createDataFrame([(body, *c) for c in cases], "b string, a string, want string").select("want", text.containing_sentence(F.col("b"), F.col("a")).alias("got")).collect()
    assert [r["got"] for r in got] == [c[1] for c in cases]


@pytest.mark.parametrize("width", [1, 8, 100])
def test_overlapping(spark, width):
    """Points, short and very long intervals, negative ends, nulls, turned ones; one stretch holds a third of all."""
    rng = random.Random(width)

    def some(n):
        out = [(i, a := rng.choice([rng.randrange(-300, 300), 7]), a + rng.choice([0, 0, 3, 20, 1000])) for i in range(n)]
        return [*out, (n, None, 5), (n + 1, 5, None), (n + 2, 9, 3), (n + 3, -100_000, 100_000), (0, 1, 1)]

    left, right = some(120), some(90)
    df = lambda rows: spark.createDataFrame(rows, "id int, lo long, hi long")
    got = sorted((tuple(r["l"]), tuple(r["r"])) for r in intervals.overlapping(df(left), df(right), "lo", "hi", width).collect())
    sound = lambda rows: [r for r in rows if None not in r and r[1] <= r[2]]
    assert got == sorted((a, b) for a in sound(left) for b in sound(right) if a[1] <= b[2] and b[1] <= a[2])
    plan = intervals.overlapping(df(left), df(right), "lo", "hi", width)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and intervals.overlapping(df([]), df(right), "lo", "hi", width).count() == 0

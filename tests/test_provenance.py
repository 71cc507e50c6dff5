"""Passages of full texts, locators, anchors, cards, integrity and prose on two-sided cases."""

from claimweave.functions import structured, text_udf
from claimweave.operators import provenance

JATS = """<article><front><p id="P0">no</p></front><body><p id="A">Lead &amp;lt; <b>bold</b>ly</p><sec id="S1"><title>One</title><p id="P1">a
 b</p><p>no anchor</p><fig/><sec><p id="P2">inner <p>nested</p> end</p><title>Two</title></sec><p id="P3">after</p><p id="P4"> </p></sec><p id="P5">open</body></article>"""


def test_jats():
    got = [(p["locator"], p["text"], p["sec"], p["title"]) for p in structured.jats(JATS)]
    assert got == [
        ("jats:A", "Lead &lt; boldly", None, None), ("jats:S1/P1", "a b", "S1", "One"), (None, "no anchor", "S1", "One"), ("jats:S1/P2", "inner nested end", "S1", "Two"), ("jats:S1/P3", "after", "S1", "One"),
    ]
    assert structured.jats("") == [] and structured.jats("</sec></p><p>x") == []


def test_latexml():
    html = """<section id="S1"><div id="S1.p1"><div>a</div> b</div><p id='S1.SS2.p3'>c</p><div id="S1.p1">again</div><div id="S1.F1">figure</div><div id="x"><p id="S2.p1">d &nbsp; e<div>f"""
    assert [(p["locator"], p["text"], p["sec"]) for p in structured.latexml(html)] == [("html:#S1.p1", "a b", "S1"), ("html:#S1.SS2.p3", "c", "S1.SS2"), ("html:#S2.p1", "d ef", "S2")]
    assert structured.latexml("") == []


def test_round_trip(spark):
    found = provenance.passages(spark.createDataFrame([(1, JATS), (2, None), (3, "")], "id long, body string"), "id", "body", "jats")
    asks = spark.createDataFrame([(1, "jats:S1/P1", "a  b"), (1, "jats:S1/P1", "after"), (1, None, "no anchor"), (1, "jats:S9", "a"), (2, "jats:A", "x"), (1, "jats:S1/P3", None)], "id long, locator string, quote string")
    got = sorted((r["id"], r["locator"] or "", r["quote"] or "", r["verdict"]) for r in provenance.round_trip(asks, found, "id").collect())
    assert got == [(1, "", "no anchor", "no_anchor"), (1, "jats:S1/P1", "a  b", "ok"), (1, "jats:S1/P1", "after", "elsewhere"), (1, "jats:S1/P3", "", "elsewhere"), (1, "jats:S9", "a", "unresolved"), (2, "jats:A", "x", "unresolved")]


def test_anchors(spark):
    rows = [("https://a", "x", 200, "2026-01-01T00:00:00Z", "v"), (None, None, None, None, None), ("HTTP://a", "", 200, "2026-01-01", "v")]
    got = provenance.build_anchors(spark.createDataFrame(rows, "url string, body string, http_status int, retrieved_at string, extractor_version string"))
    got = {r["url"]: (r["problems"], r["bytes"], r["fault"]) for r in got.withColumn("fault", provenance.anchor_fault()).collect()}
    assert got["https://a"] == ([], 1, None) and got["HTTP://a"][0] == ["bytes"]
    assert got[None] == (["url", "body", "http_status", "retrieved_at", "extractor_version", "bytes"], None, "missing object_sha256,url,retrieved_at,http_status,bytes,extractor_version")


def test_integrity(spark):
    store = provenance.put_objects(spark.createDataFrame([("a “b” c",), ("a “b” c",), ("z",), (None,)], "t string").selectExpr("cast(t as binary) as bytes"))
    keys = {bytes(r["bytes"]).decode(): r["address"] for r in store.collect()}
    assert len(keys) == 2
    damaged = store.selectExpr("address", "case when bytes = cast('z' as binary) then cast('y' as binary) else bytes end as bytes")
    cards = [("1", keys["a “b” c"], 'a "b"'), ("2", keys["a “b” c"], "gone"), ("3", keys["z"], "y"), ("4", "0" * 64, "a"), ("5", None, "a")]
    asks = spark.createDataFrame([(str(i),) for i in range(1, 7)], "evidence_id string")
    got = provenance.integrity(asks, spark.createDataFrame(cards, "evidence_id string, object_sha256 string, quote string"), damaged)
    assert {r["evidence_id"]: r["verdict"] for r in got.collect()} == {"1": "intact", "2": "mutated", "3": "mutated", "4": "missing", "5": "missing", "6": "not_covered"}


def test_bare_numbers():
    cases = {
        "CA 19-9 rose": [], "COVID-19 and p53": [], "19 例": ["19"], "9 % and XCII%": ["9", "XCII%"], "四千五百二十三名患者": ["四千五百二十三名"], "{{claim:a.b}} 十亿美元": [], "2019 年": [], "共纳入 2019 名": ["2019"], "第 3 节": [], "９２％": ["92"],
    }
    assert {k: text_udf.bare_numbers(k) for k in cases} == cases


def test_compose(spark):
    claims = spark.createDataFrame([("c1", {"v": "7", "u": None}, "verified", 3, 2), ("c2", None, "odd", None, 1)], "claim_id string, fields map<string,string>, status string, sources int, clusters int")
    rows = ["{{claim:c1.v}} and {{claim:c1.v}}", "{{claim:c2.v}}", "{{claim:c1.x}}{{claim:c9.v}}", "no number", "GPT4", "", "{{claim:c1.u}}.", None]
    got = provenance.compose(spark.createDataFrame(list(enumerate(rows)), "id int, skeleton string"), claims)
    got = {r["id"]: (r["prose"], r["denial"]) for r in got.collect()}
    one = "7〔已验证，来源 3/独立簇 2〕"
    assert got == {
        0: (f"{one} and {one}", None), 1: (None, "missing c2.v"), 2: (None, "missing c1.x,c9.v"), 3: ("no number", None), 4: (None, "no placeholder"), 5: ("", None), 6: ("null〔已验证，来源 3/独立簇 2〕.", None), 7: (None, None),
    }


def test_full_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    found = provenance.passages(spark.createDataFrame([(i, f'<div id="S1.p{i}">a</div>') for i in range(500)], "id long, body string").coalesce(1), "id", "body", "html")
    assert found.count() == 500 and int(spark.conf.get(key)) <= 200
    spark.conf.set(key, "50")
    provenance.passages(found.selectExpr("id", "text as body"), "id", "body", "html")
    assert spark.conf.get(key) == "50"
    spark.conf.unset(key)

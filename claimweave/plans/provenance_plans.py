"""Queries about provenance, bound to documents and pages. Full texts are made from the lines of documents, so that SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import provenance
from claimweave.plans.registry import query
from claimweave.plans.text_plans import passage_rows
from claimweave.sources.tables import load

_LINES = """l as (select doc_id, k - 1 as k, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents) where trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '')"""
_QUOTE = "regexp_replace(regexp_replace(trim(regexp_replace(replace(translate(t, '‘’“”–—', '''''\"\"--'), '…', '...'), '\\s+', ' ', 'g')), '([{c}])\\s+', '\\1', 'g'), '\\s+([{c}])', '\\1', 'g')".replace("{c}", text.QUOTE_CJK)
_PAGE = "b as (select page_id, html, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) as t, generate_subscripts(regexp_extract_all(html, '<p>([^<]*)</p>', 1), 1) as ord from pages)"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def jats_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): two lines in a section, the others in one within it; every third line has no id."""
    block = lambda line, k: F.concat(F.lit("<p"), F.when(k % 3 != 0, F.concat(F.lit(' id="P'), k, F.lit('"'))).otherwise(""), F.lit(">"), escaped(line), F.lit("</p>"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), block).alias("ps"))
    ends = [F.array_join(F.slice("ps", 1, 2), ""), F.array_join(F.slice("ps", F.lit(3), F.greatest(F.size("ps"), F.lit(1))), "")]
    return d.select("doc_id", F.concat(F.lit('<article><body><sec id="S1"><title>Part <i>one</i></title>'), ends[0], F.lit('<sec id="S2">'), ends[1], F.lit("</sec></sec></body></article>")).alias("body"))


_JATS = f"with {_LINES}, j as (select doc_id, k, t, case when k < 2 then 'S1' else 'S2' end as sec, case when k % 3 <> 0 then 'jats:' || case when k < 2 then 'S1' else 'S2' end || '/P' || k end as locator from l)"


@query(f"{_JATS} select doc_id, sec, locator, 'Part one' as title, cast(length(t) as bigint) as n, sha256(t) as h from j")
def jats_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of JATS texts with the locators of those that have an id."""
    found = provenance.passages(jats_texts(spark, sf_dir), "doc_id", "body", "jats")
    return found.select("doc_id", "sec", "locator", "title", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h"))


@query(f"with {_LINES} select doc_id, case when k % 2 = 0 then 'S1' else 'S1.SS2' end as sec, 'html:#' || case when k % 2 = 0 then 'S1' else 'S1.SS2' end || '.p' || (k + 1) as locator, cast(length(t) as bigint) as n, sha256(t) as h from l")
def latexml_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of LaTeXML pages whose ids are those of paragraphs; a block may hold others of its own kind."""
    even = lambda line, k: F.concat(F.lit('<div class="ltx_para" id="S1.p'), k + 1, F.lit('"><p class="ltx_p">'), escaped(line), F.lit("</p></div>"))
    odd = lambda line, k: F.concat(F.lit('<div id="S1.SS2.p'), k + 1, F.lit('"><div>'), escaped(line), F.lit("</div></div>"))
    blocks = F.transform(F.split("text", "\n", -1), lambda line, k: F.when(k % 2 == 0, even(line, k)).otherwise(odd(line, k)))
    pages = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<section id="S1">'), F.array_join(blocks, ""), F.lit("</section>")).alias("body"))
    found = provenance.passages(pages, "doc_id", "body", "html")
    return found.select("doc_id", "sec", "locator", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h"))


@query(f"{_JATS} select doc_id, cast(k as int) as k, case when k % 5 = 0 then 'unresolved' when k % 3 = 0 then 'no_anchor' when k % 4 = 0 then 'elsewhere' else 'ok' end as verdict from j")
def locator_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether locators lead back to their quotes; every fifth leads nowhere, every fourth quote stands nowhere."""
    found = provenance.passages(jats_texts(spark, sf_dir), "doc_id", "body", "jats")
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).select("doc_id", "k", text.squeeze(F.col("line")).alias("t")).where("t <> ''")
    sec = F.when(F.col("k") < 2, "S1").otherwise("S2")
    locator = F.when(F.col("k") % 5 == 0, F.concat(F.lit("jats:S9/P"), "k")).when(F.col("k") % 3 != 0, F.concat(F.lit("jats:"), sec, F.lit("/P"), "k"))
    quote = F.when(F.col("k") % 4 == 0, "stands nowhere, not here").otherwise(F.substring("t", 1, 20))
    return provenance.round_trip(lines.select("doc_id", "k", locator.alias("locator"), quote.alias("quote")), found, "doc_id").select("doc_id", "k", "verdict")


@query(f"""{_JATS}, q as (select doc_id, k as ask, case when k % 7 = 6 then 'stands nowhere, not here' else trim(substr(t, 3, 24)) end as quote from j where trim(substr(t, 3, 24)) <> ''),
 f as (select q.doc_id as doc_id, ask, min(k) as k from q join j on j.doc_id = q.doc_id and j.locator is not null and contains(j.t, q.quote) group by q.doc_id, ask)
 select q.doc_id as doc_id, cast(q.ask as int) as ask, coalesce(j.locator, 'unaddressable') as locator, j.locator is not null as roundtrip_verified from q left join f on f.doc_id = q.doc_id and f.ask = q.ask left join j on j.doc_id = f.doc_id and j.k = f.k""")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence built from quotes: the first passage of the text that holds each, its locator and the way back. Every seventh quote stands nowhere."""
    found = provenance.passages(jats_texts(spark, sf_dir), "doc_id", "body", "jats")
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ask", "line")).select("doc_id", "ask", text.squeeze(F.col("line")).alias("t")).where("t <> ''")
    quote = F.trim(F.substring("t", 3, 24))
    asks = lines.where(quote != "").select("doc_id", "ask", F.when(F.col("ask") % 7 == 6, "stands nowhere, not here").otherwise(quote).alias("quote"))
    return provenance.evidence(asks, found, "doc_id").select("doc_id", "ask", "locator", "roundtrip_verified")


_FETCH = """f as (select page_id, case when page_id % 9 = 0 then 'ftp://host/x' else url end as url, html as body, case when page_id % 10 = 0 then 404 else 200 end as status, page_id % 8 = 0 as late, page_id % 12 = 0 as unnamed from pages)"""


@query(f"""with {_FETCH}, p as (select *, concat_ws(',', case when not coalesce(regexp_matches(url, '(?i)^https?://'), false) then 'url' end, case when body is null then 'body' end, case when status <> 200 then 'http_status' end, case when late then 'retrieved_at' end,
 case when unnamed then 'extractor_version' end, case when coalesce(octet_length(encode(body)), 0) = 0 then 'bytes' end) as problems from f)
 select page_id, problems, case when problems = '' then sha256(body) end as object_sha256, case when problems = '' then cast(octet_length(encode(body)) as bigint) end as bytes, case when problems <> '' then 'missing object_sha256,bytes' || case when unnamed then ',extractor_version' else '' end end as fault from p""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of snapshots, with what forbids one and what a reader finds wrong with it."""
    p = load(spark, sf_dir, "pages")
    every = lambda n, a, b: F.when(F.col("page_id") % n == 0, a).otherwise(b)
    fetches = p.select(
        "page_id", every(9, F.lit("ftp://host/x"), F.col("url")).alias("url"), F.col("html").alias("body"), every(10, F.lit(404), F.lit(200)).alias("http_status"),
        every(8, F.lit("soon"), F.lit("2026-01-02T03:04:05Z")).alias("retrieved_at"), every(12, F.lit(""), F.lit("x-1")).alias("extractor_version"))
    built = provenance.build_anchors(fetches)
    return built.select("page_id", F.array_join("problems", ",").alias("problems"), "object_sha256", "bytes", provenance.anchor_fault().alias("fault"))


@query("select sha256(text) as address, cast(octet_length(encode(any_value(text))) as bigint) as bytes from documents where text is not null group by 1")
def cas_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct contents of documents by their addresses."""
    return provenance.put_objects(load(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("bytes"))).select("address", F.octet_length("bytes").cast("long").alias("bytes"))


@query(f"""with {_PAGE} select page_id, cast(ord as int) as ord, case when ord % 6 = 0 or t = '' then null else sha256('page-' || page_id || ' v1 p' || ord || ' ' || {_QUOTE} || ' x-1') end as evidence_id,
 concat_ws(',', case when t = '' then 'quote' end, case when ord % 6 = 0 then 'extractor_version' end) as missing from b""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of evidence cards, digests of their five parts, and the parts that are missing."""
    rows = passage_rows(spark, sf_dir)
    cards = rows.select(
        "page_id", F.col("ord").cast("int").alias("ord"), F.concat(F.lit("page-"), "page_id").alias("work_id"), F.lit("v1").alias("version_id"), F.concat(F.lit("p"), "ord").alias("locator"),
        F.col("text").alias("quote"), F.when(F.col("ord") % 6 == 0, "").otherwise("x-1").alias("extractor_version"))
    return provenance.with_card_id(cards).select("page_id", "ord", "evidence_id", F.array_join("missing", ",").alias("missing"))


@query(f"""with {_PAGE} select page_id || '/' || ord as evidence_id, case when page_id % 13 = 0 then 'not_covered' when substr(sha256(html), 1, 1) in ('0', '1') then 'missing' when substr(sha256(html), 1, 1) in ('2', '3') or ord % 4 = 0 then 'mutated' else 'intact' end as verdict from b""")
def source_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether snapshots still hold what cards quote; some objects are lost or damaged (by their address), some quotes gone."""
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    rows = passage_rows(spark, sf_dir).select("page_id", "ord", "text", F.concat("page_id", F.lit("/"), "ord").alias("evidence_id"))
    quote = F.when(F.col("ord") % 4 == 0, "stands nowhere, not here").otherwise(F.col("text"))
    cards = rows.where("page_id % 13 <> 0").join(pages.select("page_id", F.sha2("html", 256).alias("object_sha256")), "page_id").select("evidence_id", "object_sha256", quote.alias("quote"))
    store, first = provenance.put_objects(pages.select(F.col("html").cast("binary").alias("bytes"))), F.substring("address", 1, 1)
    store = store.where(~first.isin("0", "1")).select("address", F.when(first.isin("2", "3"), F.concat("bytes", F.lit(b"x"))).otherwise(F.col("bytes")).alias("bytes"))
    return provenance.integrity(rows.select("evidence_id"), cards, store)


@query("""with c as (select 'c' || c_custkey as id, cast(cast(floor(c_acctbal) as bigint) as varchar) as v, case c_custkey % 3 when 0 then '已验证' when 1 then '已归因' else '?other' end || case when c_custkey % 2 = 0 then '，来源 ' || c_custkey || '/独立簇 ' || c_nationkey else '' end as m from customer)
 select o_orderkey as id, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else 'Balance ' || v || '〔' || m || '〕, again ' || v || '〔' || m || '〕.' end as prose,
 case when o_orderkey % 11 = 0 then 'bare 92' when o_orderkey % 13 = 0 then 'no placeholder' when o_orderkey % 7 = 0 then 'missing none.value,c' || o_custkey || '.none' end as denial from orders join c on c.id = 'c' || o_custkey""")
def compose_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons with two placeholders each; some lead nowhere, some have a bare number, some a digit in a name and no placeholder."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    slot = lambda field: F.concat(F.lit("{{claim:c"), "o_custkey", F.lit(f".{field}}}}}"))
    skeleton = (
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("It rose by 92 to "), slot("value"))).when(F.col("o_orderkey") % 13 == 0, "See GPT4 on this.")
        .when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("{{claim:none.value}} of "), slot("none"))).otherwise(F.concat(F.lit("Balance "), slot("value"), F.lit(", again "), slot("value"), F.lit(".")))
    )
    two = F.col("c_custkey") % 2 == 0
    claims = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("claim_id"), F.create_map(F.lit("value"), F.floor("c_acctbal").cast("string")).alias("fields"),
        F.when(F.col("c_custkey") % 3 == 0, "verified").when(F.col("c_custkey") % 3 == 1, "attributed").otherwise("other").alias("status"), F.when(two, F.col("c_custkey")).alias("sources"), F.when(two, F.col("c_nationkey")).alias("clusters"))
    known = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return provenance.compose(known.select(F.col("o_orderkey").alias("id"), skeleton.alias("skeleton")), claims)

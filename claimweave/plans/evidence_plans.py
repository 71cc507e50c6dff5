"""Queries about normal forms, passages, search boxes, filters and exports, bound to documents, pages, conversations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import brief, graph, retrieve, vectors
from claimweave.plans.graph_plans import _G, _TREE, edges, moves, nodes
from claimweave.plans.registry import query
from claimweave.plans.text_plans import _PAIR, passage_rows, vectors_of
from claimweave.sources.tables import load


@query("select doc_id, cast(length(t) as bigint) as n, sha256(t) as h from (select doc_id, regexp_replace(text, '([A-Za-z0-9_])-[ \\t]*\\n\\s*([A-Za-z0-9_])', '\\1\\2', 'g') as t from documents)")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose words are no longer broken over the ends of lines."""
    t = text.dehyphenate(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("h"))


@query("select doc_id, cast(length(t) as bigint) as n, sha256(t) as h from (select doc_id, trim(regexp_replace(replace(translate(text, '‘’“”–—' || chr(160), '''''\"\"-- '), '…', '...'), '\\s+', ' ', 'g')) as t from documents)")
def norm_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early normal form: folded marks, single blanks."""
    t = text.norm_v0(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("h"))


@query(f"select item_id, case when regexp_matches(q, '[{text.QUOTE_CJK}]') then regexp_replace(q, '\\s+', '', 'g') else q end as quote from (select item_id, trim(regexp_replace(replace(translate(text, '‘’“”–—', '''''\"\"--'), '…', '...'), '\\s+', ' ', 'g')) as q from benchmark)")
def normalize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control form: all blanks go where any Chinese character stands."""
    return load(spark, sf_dir, "benchmark").select("item_id", text.normalize_legacy(F.col("text")).alias("quote"))


@query("""with b as (select page_id, url, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) as t, generate_subscripts(regexp_extract_all(html, '<p>([^<]*)</p>', 1), 1) as ord from pages)
 select page_id, cast(ord as int) as ord, cast(length(t) as bigint) as n from b where contains(lower(url), 'thes') or page_id in (select page_id from b where contains(lower(t), 'thes'))""")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of the pages whose address or any passage has the words asked for."""
    rows = passage_rows(spark, sf_dir).select("page_id", F.col("ord").cast("int").alias("ord"), "text")
    titles = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"))
    return retrieve.search_box(titles, rows, "page_id", "thes").select("page_id", "ord", F.length("text").cast("long").alias("n"))


@query(f"with {_G} select 'node' as kind, node as id, lane from n where not rejected and lane = 4 union all select 'edge', edge, n.lane from e left join n on n.node = e.source where n.lane = 4")
def graph_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by state and lane; an edge has the lane of its source, none where the source is missing."""
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir).join(n.select(F.col("node").alias("source"), "lane"), "source", "left")
    return n.where("not rejected and lane = 4").select(F.lit("node").alias("kind"), F.col("node").alias("id"), "lane").union(e.where("lane = 4").select(F.lit("edge"), "edge", "lane"))


@query(_PAIR + " select q, v, cast(r as int) as place, round(cos, 5) as cos from (select *, row_number() over (partition by q order by round(cos, 6) desc, v) as r from p where ql <> vl) where r <= 3")
def advisory_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest records of other groups, ties (six places) by id."""
    # rounding may lift those a place behind
    p = vectors.best(*vectors_of(spark, sf_dir), 3, "other", margin=2e-6).select("q", "v", "cos", F.round("cos", 6).alias("near"))
    return retrieve.top_k(p, "q", "near", "v", 3).select("q", "v", "place", F.round("cos", 5).alias("cos"))


@query(f"""{_TREE}, s as (select case when lane % 5 = 0 then 'background' when lane % 5 = 1 then 'evidence' when lane % 5 = 2 then 'counter' when lane % 5 = 3 then 'open' end as section, depth, n.node as node from n join p on p.node = n.node where not rejected)
 select section, case section when 'background' then 1 when 'evidence' then 2 when 'counter' then 3 else 4 end as place, string_agg(node, ',' order by depth, node) as members from s where section is not null group by section""")
def section_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in the order of the template, each with its nodes by layer and id; empty ones are dropped."""
    names = F.array(*map(F.lit, ("background", "evidence", "counter", "open")))
    s = nodes(spark, sf_dir).where("not rejected").withColumn("place", (F.col("lane") % 5 + 1).cast("int")).where("place <= 4")
    s = s.join(graph.paths(nodes(spark, sf_dir)).select("node", "depth"), "node")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"].cast("string")), ",")
    return s.groupBy("place").agg(listed.alias("members")).select(F.element_at(names, F.col("place")).alias("section"), "place", "members")


@query(_TREE + " select node, repeat('  ', depth) || '- ' || node as line, array_to_string(list_transform(string_split(path, '/'), lambda x: lpad(x, 10, '0')), '/') as place from p")
def tree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the tree as an indented list; sorted by place they stand depth first."""
    p = graph.paths(nodes(spark, sf_dir))
    return p.select("node", F.concat(F.expr("repeat('  ', depth)"), F.lit("- "), F.col("node")).alias("line"), F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 10, "0")), "/").alias("place"))


@query(_TREE + ", o as (select o_orderkey, o_custkey, (o_orderkey * 11 + 5) % 120 as other from orders) select o_orderkey, not (a.path = b.path or starts_with(b.path, a.path || '/')) as allowed from o join p a on a.node = o.o_custkey join p b on b.node = o.other")
def reparent_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node may move below another: not below itself or what hangs from it."""
    distance = graph.distance_class(F.col("path"), F.col("up"), F.col("path2"), F.col("up2"))
    return moves(spark, sf_dir).select("o_orderkey", (~distance.isin(0, 1)).alias("allowed"))


@query("select doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '\\b(\\d{4})\\b', 1), lambda y: cast(y as int))) >= 2025, false) as news from documents where text is not null")
def news_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any year that a text names is last year or later (the clock stands at 2026)."""
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.recent_year(F.col("text"), 2026).alias("news"))


SECTIONS, ROOM = ["user", "system", "assistant"], 900


# the entries of a conversation in order, walked one by one: b is the text so far, o whether the section is open, left what the section has from this line on
@query(f"""with recursive l as (select conv_id, role, case role when 'user' then 1 when 'system' then 2 else 3 end as s, turn, '- ' || turn || ' ' || coalesce(text, '') as line from conversations where role in ('user', 'system', 'assistant')),
e as (select conv_id, s, 0 as head, chr(10) || '## ' || any_value(role) as line, cast(0 as bigint) as turn, count(*) as left_over from l group by conv_id, s union all select conv_id, s, 1, line, turn, count(*) over (partition by conv_id, s order by turn desc, line desc rows unbounded preceding) from l),
k as materialized (select *, row_number() over (partition by conv_id order by s, head, turn, line) as k from e),
w as (select distinct conv_id, cast(0 as bigint) as k, '' as b, cast(0 as bigint) as used, cast(0 as bigint) as dropped, true as o from k
 union all select conv_id, k, case when fits then b || line || chr(10) else b end, case when fits then used + length(line) + 1 else used end, case when not fits and (head = 0 or o) then dropped + left_over else dropped end, fits
 from (select w.conv_id, k.k, w.b, w.used, w.dropped, w.o, k.line, k.head, k.left_over, w.used + length(k.line) + 1 <= {ROOM - 64} and (k.head = 0 or w.o) as fits from w join k on k.conv_id = w.conv_id and k.k = w.k + 1))
select conv_id, regexp_replace(b || case when dropped > 0 then chr(10) || '[truncated: ' || dropped || ' lines over budget]' else '' end, '^\\s+|\\s+$', '', 'g') || chr(10) as body, used, dropped from w qualify k = max(k) over (partition by conv_id)""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief of each conversation in a budget of characters: what was asked, what was set, what was answered, and how many lines are left out."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("- "), "turn", F.lit(" "), F.coalesce("text", F.lit(""))).alias("line"))
    return brief.render(c, "conv_id", "role", "turn", "line", SECTIONS, ROOM).select("conv_id", "body", F.col("used").cast("long").alias("used"), "dropped")


@query("""with s as (select item_id, text as body, regexp_extract_all(text, '(?:\\d[.;]\\d|[^.;。；])+[.;。；]?') as parts from benchmark), k as (select item_id, body, unnest(parts) as part, generate_subscripts(parts, 1) as i from s)
 select item_id, cast(i as int) as i, trim(part) as sentence, coalesce(trim(lead(part) over (partition by item_id, body order by i)), '') as following from k qualify trim(part) <> ''""")
def following_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of an item and the one after it. A dot or semicolon between two digits ends none."""
    parts = F.regexp_extract_all("text", F.lit(r"(?:\d[.;]\d|[^.;。；])+[.;。；]?"), F.lit(0))
    s = load(spark, sf_dir, "benchmark").select("item_id", parts.alias("parts")).select("item_id", "parts", F.posexplode("parts").alias("k", "part")).where(F.trim("part") != "")
    return s.select("item_id", (F.col("k") + 1).cast("int").alias("i"), F.trim("part").alias("sentence"), F.coalesce(F.trim(F.get("parts", F.col("k") + 1)), F.lit("")).alias("following"))

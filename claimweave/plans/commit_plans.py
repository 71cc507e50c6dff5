"""Queries about commits, bundles, identities of references and the last rules, bound to customers, orders, lines, documents and pages.

Records are customers. Each one's last order is its verdict, by the order's priority; as an order of the owner, every order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import cluster, commit, graph
from claimweave.operators.rules import audit, dangling, violation
from claimweave.plans import rules_plans  # noqa: F401
from claimweave.plans.graph_plans import _G, edges, nodes
from claimweave.plans.registry import ORACLES, QUERIES, query
from claimweave.sources.tables import load

_RECORD = """c_custkey as id, case when c_custkey % 3 = 0 then 'edge' else 'node' end as kind, case c_mktsegment when 'AUTOMOBILE' then 'parked' when 'BUILDING' then 'candidate' when 'FURNITURE' then 'pending_proof' else 'active' end as state,
 case when c_mktsegment = 'AUTOMOBILE' then 'not_needed' end as reason, case when c_mktsegment in ('MACHINERY', 'HOUSEHOLD') then 'strong' else 'unassessed' end as strength, 1 + c_custkey % 3 as version, c_name as claim, c_acctbal < 0 as frozen, case when c_nationkey % 2 = 0 then c_nationkey end as proof"""
_VERDICT = """select o_custkey as id, max(o_orderkey) as proof, {last} as priority from orders group by o_custkey"""
_OUTCOME = "case priority when '1-URGENT' then 'pass' when '2-HIGH' then 'narrow' when '3-MEDIUM' then 'bridge' when '5-LOW' then 'rejected' else 'needs_docs' end as outcome"
_V = f"r as (select {_RECORD} from customer), l as ({_VERDICT.format(last='arg_max(o_orderpriority, o_orderkey)')}), v as (select id, proof, {_OUTCOME} from l)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(*[c.strip() for c in _split(_RECORD)])


def _split(columns: str) -> list[str]:
    """The expressions of a select list: commas inside brackets part nothing."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("proof"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return o.selectExpr("id", "proof", _OUTCOME)


@query(f"""with {_V} select v.id as id, kind, case outcome when 'pass' then 'active' when 'narrow' then 'needs_repair' when 'bridge' then 'needs_repair' else outcome end as state, case when outcome in ('narrow', 'bridge') then outcome when outcome = 'rejected' then 'contradicted' end as reason,
 case when outcome <> 'pass' then 'unassessed' when v.proof % 2 = 0 then 'strong' else 'conditional' end as strength, version + case when outcome = 'narrow' then 1 else 0 end as version, case when outcome = 'narrow' then 'narrowed ' || v.proof else claim end as claim, frozen, v.proof as proof from v join r on r.id = v.id""")
def commit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that verdicts append: pass, narrow, bridge, needs_docs, rejected."""
    grade = F.when(F.col("proof") % 2 == 0, "strong").otherwise("conditional")
    v = verdicts(spark, sf_dir).select("id", "outcome", grade.alias("grade"), F.concat(F.lit("narrowed "), "proof").alias("narrowed"), F.lit("contradicted").alias("why"), "proof")
    return commit.applied(records(spark, sf_dir), v)


@query("""with g as (select c_custkey as id, c_custkey // 2 as target, c_nationkey as lane from customer where c_custkey % 4 < 2), p as (select o_custkey as id, o_orderkey as seq, 'premise ' || o_orderkey as claim, case when o_orderpriority = '5-LOW' then 'definition' else 'fact' end as node_type, row_number() over (partition by o_custkey order by o_orderkey) as place from orders)
 select g.id as id, place, claim, node_type, lane, target as parent, case when node_type = 'definition' then 'depends_on' else 'supports' end as edge_type, 'pending_proof' as state from g join p on p.id = g.id where place <= 2""")
def commit_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes and edges that close a gap; an edge with two rounds behind it gets none."""
    gaps = load(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey div 2 as target", "c_nationkey as lane", "c_custkey % 4 as rounds")
    proposals = load(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderkey as seq", "concat('premise ', o_orderkey) as claim", "case when o_orderpriority = '5-LOW' then 'definition' else 'fact' end as node_type")
    return commit.bridged(gaps, proposals)


@query(f"""with {_V}, x as (select *, proof % 4 as rounds, proof % 3 = 0 as saturated, proof % 2 = 0 as floor_met, id % 3 as misses from v)
 select id, 'enqueue' as op, null as detail from x where outcome = 'narrow' or (outcome = 'needs_docs' and not saturated and misses = 0) union all select id, 'cancel', null from x where outcome = 'rejected'
 union all select id, 'dead_letter', 'bridge cap reached' from x where outcome = 'bridge' and rounds >= 2 union all select id, 'enqueue', 'blocked by bridges' from x where outcome = 'bridge' and rounds < 2
 union all select id, 'dead_letter', 'saturated, floor_met=' || floor_met from x where outcome = 'needs_docs' and saturated union all select id, 'human_review', null from x where outcome = 'needs_docs' and saturated and floor_met
 union all select id, 'enqueue', 'blocked by ' || misses from x where outcome = 'needs_docs' and not saturated and misses > 0""")
def commit_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verdicts put into the queue: checks, dead letters, reviews, cancellations."""
    return commit.follow_ups(verdicts(spark, sf_dir).selectExpr("id", "outcome", "proof % 4 as rounds", "proof % 3 = 0 as saturated", "proof % 2 = 0 as floor_met", "id % 3 as misses"))


_ORDER = """o_orderkey as cmd, o_custkey + case when o_orderkey % 31 = 0 then 100000000 else 0 end as id, case o_orderpriority when '1-URGENT' then 'park' when '2-HIGH' then 'unpark' when '3-MEDIUM' then 'freeze' when '5-LOW' then 'unfreeze' else 'reopen' end as op,
 case when o_orderkey % 4 in (0, 2) then 'absorbed' when o_orderkey % 4 = 1 then 'not_needed' else 'other' end as why, case when o_orderkey % 5 > 0 then o_orderkey % 100 end as into"""


_REFUSED = "case when o.op = 'park' then case when s.state not in ('active', 'candidate') then 'state' when s.frozen then 'frozen' when o.why not in ('absorbed', 'not_needed') then 'reason' when o.why = 'absorbed' and (o.goes is null or o.goes = o.id or {active} is distinct from 'active') then 'into' end when o.op = 'unpark' and s.state <> 'parked' then 'state' end as refused"
_NEXT = """case when refused is not null then state else case op when 'park' then 'parked' when 'unpark' then case when proven then 'pending_proof' else 'candidate' end when 'freeze' then state else 'pending_proof' end end as state,
  case when refused is not null then reason when op = 'park' then why when op in ('unpark', 'reopen') then null else reason end as reason, case when refused is not null or op = 'freeze' then strength else 'unassessed' end as strength, case when refused is not null then frozen when op = 'freeze' then true when op = 'unfreeze' then false else frozen end as frozen, proven,
  case when refused is not null then goes when op = 'park' then case when why = 'absorbed' then target end when op = 'unpark' then null else goes end as goes, op, refused, refused is null and (op in ('unfreeze', 'reopen') or (op = 'unpark' and proven)) as queued"""
_OLD = "s.state as state, s.reason as reason, s.strength as strength, s.frozen as frozen, s.proven as proven, s.goes as goes, o.id as id, o.cmd as cmd, o.op as op, o.why as why, o.goes as target"


# orders go into records below 100 alone: those are walked first, one order after another, and the others record by record beside them
@query(f"""with recursive r as (select {_RECORD} from customer), g as (select id, state, reason, strength, frozen, proof is not null as proven, cast(null as bigint) as goes from r),
o as materialized (select *, row_number() over (partition by id order by cmd) as n from (select {_ORDER.replace(" as into", " as goes")} from orders)),
ho as materialized (select *, row_number() over (order by cmd) as k from o where id < 100 and id in (select id from r)),
t(tag, key, id, k, state, reason, strength, frozen, proven, goes, op, refused, queued) using key (tag, key) as (
 select 'r', id, id, cast(0 as bigint), state, reason, strength, frozen, proven, goes, cast(null as varchar), cast(null as varchar), false from g where id < 100
 union select tag, case tag when 'r' then id else cmd end, id, k, {_NEXT}
 from (select o.k as k, {_OLD}, {_REFUSED.format(active="x.state")}
  from ho o join (select max(k) + 1 as k from t) w on o.k = w.k join recurring.t s on s.tag = 'r' and s.id = o.id left join recurring.t x on x.tag = 'r' and x.id = o.goes) y, (values ('r'), ('c')) z(tag)),
h as materialized (select key as cmd, id, state from t where tag = 'c' and refused is null),
o2 as materialized (select o.*, coalesce(h.state, g.state) as there from (select * from o where id >= 100) o asof left join h on h.id = o.goes and o.cmd > h.cmd left join g on g.id = o.goes),
q as (select id, cast(0 as bigint) as n, cast(null as bigint) as cmd, state, reason, strength, frozen, proven, goes, cast(null as varchar) as op, cast(null as varchar) as refused, false as queued from g where id >= 100
 union all select id, n, cmd, {_NEXT} from (select o.n as n, {_OLD}, {_REFUSED.format(active="o.there")} from q s join o2 o on o.id = s.id and o.n = s.n + 1) y),
f as (select key as cmd, id, op, refused, state, reason, goes, strength, frozen, queued from t where tag = 'c' union all select cmd, id, op, refused, state, reason, goes, strength, frozen, queued from q where n > 0)
select cmd, id, op, refused, case when refused is null then state end as state, case when refused is null then reason end as reason, case when refused is null then goes end as absorbed_into,
 case when refused is null then strength end as strength, case when refused is null then frozen end as frozen, case when refused is null then queued end as queued from f
union all select cmd, id, op, 'missing', null, null, null, null, null, null from o where id not in (select id from r)""")
def owner_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Park, unpark, freeze, unfreeze and reopen, one after another: what each order does to what those before it left, or why it is refused."""
    o = load(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_ORDER)])
    return commit.in_sequence(records(spark, sf_dir), o)


_SIG = "select source as target, target as id, {} as signature from e union select source, source, {} from e"


@query(f"""with {_G}, b as ({_SIG.format('target % 7', 'source % 7')}), w as (select target, id, case when id % 41 = 5 then signature + 1 else signature end as signature from b where not (target % 10 = 3 and id <> target))
 select coalesce(b.target, w.target) as target, bool_and(b.signature is not distinct from w.signature and b.signature is not null) as current from b full join w on w.target = b.target and w.id = b.id group by 1""")
def bundle_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a target and its neighbours still are what its bundle was made from."""
    e = edges(spark, sf_dir)
    b = e.selectExpr("source as target", "target as id", "target % 7 as signature").union(e.selectExpr("source", "source", "source % 7")).distinct()
    now = b.where("not (target % 10 = 3 and id <> target)").selectExpr("target", "id", "case when id % 41 = 5 then signature + 1 else signature end as signature")
    return commit.current(b, now)


@query(f"""with {_G}, h as (select source as node, edge, target as near from e where source <> target union select target, edge, source from e where source <> target), s as (select node, array_to_string(list_sort(list_distinct(list(near))), ',') as near, array_to_string(list_sort(list_distinct(list(edge))), ',') as edges from h group by node),
 p as (select o_custkey as node, max(o_orderkey) as last, cast(count(*) as bigint) as prior from orders group by o_custkey)
 select n.node as target, case when n.node % 3 = 0 then 'EDGE_CHECK' else 'NODE_CHECK' end as task, 'PT-' || n.node || '-r' || (coalesce(prior, 0) + 1) as bundle, coalesce(s.near, '') as near, coalesce(s.edges, '') as edges, last as last_result, coalesce(prior, 0) as prior from n left join s on s.node = n.node left join p on p.node = n.node where not rejected""")
def task_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker gets for a target: the next revision, the neighbours and edges, earlier results."""
    n, e = nodes(spark, sf_dir).where("not rejected"), edges(spark, sf_dir).where("source <> target")
    ends = e.selectExpr("source as node", "edge", "target as near").union(e.selectExpr("target", "edge", "source"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    own = ends.join(n.select("node"), "node", "left_semi").groupBy("node").agg(listed("near").alias("near"), listed("edge").alias("edges"))
    past = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.max("o_orderkey").alias("last_result"), F.count(F.lit(1)).alias("prior"))
    task, prior = F.when(F.col("node") % 3 == 0, "EDGE_CHECK").otherwise("NODE_CHECK"), F.coalesce("prior", F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return n.select("node").join(own, "node", "left").join(past, "node", "left").select(F.col("node").alias("target"), task.alias("task"), F.concat(F.lit("PT-"), "node", F.lit("-r"), prior + 1).alias("bundle"), blank("near"), blank("edges"), "last_result", prior.alias("prior"))


_NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_REFS = f"r as (select doc_id as id, case when doc_id % 6 = 0 then '10.1/' || n_chars % 50 end as doi, case when doc_id % 6 = 1 then 'hep.' || n_chars % 40 || 'v' || doc_id % 3 end as arxiv_id, case when doc_id % 6 = 2 then 'W' || n_chars % 60 end as work_id, {_NORM.format('string_split(text, chr(10))[1]')} as title, {_NORM.format('source')} as author from documents)"
_KEYED = f"{_REFS}, k as (select id, case when doi is not null then 'doi:' || {_NORM.format('doi')} when arxiv_id is not null then 'arxiv:' || regexp_replace({_NORM.format('arxiv_id')}, 'v\\d+$', '') when work_id is not null then 'work:' || {_NORM.format('work_id')} end as exact_key, case when title <> '' and author <> '' then 'ta:' || title || '|' || author end as ta_key from r)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    own = lambda n, of, e: F.expr(f"case when doc_id % 6 = {n} then {e} end").alias(of)
    return d.select(F.col("doc_id").alias("id"), own(0, "doi", "concat('10.1/', n_chars % 50)"), own(1, "arxiv_id", "concat('hep.', n_chars % 40, 'v', doc_id % 3)"), own(2, "work_id", "concat('W', n_chars % 60)"), F.split("text", "\n").getItem(0).alias("title"), F.col("source").alias("author"))


@query(f"with {_KEYED} select id, exact_key, sha256(ta_key) as ta_hash from k")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference is known by: DOI, else arXiv number without version, else work; title with first author."""
    return cluster.with_keys(references(spark, sf_dir)).select("id", "exact_key", F.sha2("ta_key", 256).alias("ta_hash"))


@query(f"""with recursive {_KEYED}, e as (select a.id as x, min(b.id) as y from k a join k b on a.exact_key = b.exact_key group by a.id union select a.id, min(b.id) from k a join k b on a.ta_key = b.ta_key group by a.id), u as (select x, y from e where x <> y union select y, x from e where x <> y),
 q as (select x, y from u union select q.x, u.y from q join u on u.x = q.y), m as (select x, min(y) as y from q group by x) select k.id as id, least(k.id, coalesce(m.y, k.id)) as root from k left join m on m.x = k.id""")
def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by identifier and by title with first author."""
    refs = graph.cut(cluster.with_keys(references(spark, sf_dir)).select("id", "exact_key", "ta_key"))
    return cluster.independent(refs, [cluster.star(refs, "exact_key", "exact-id"), cluster.star(refs, "ta_key", "same-title-first-author")])


_TITLE = "trim(string_split(text, chr(10))[1])"


@query(f"""with t as (select 2 * doc_id as id, {_TITLE} as t from documents union all select 2 * doc_id + 1, {_TITLE} || ' revised' from documents), i as (select min(id) as id, w from (select id, list_sort(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'))) as w from t) where len(w) > 0 group by w),
 u as (select id, len(w) as n, unnest(w) as x from i), p as (select a.id as a, b.id as b, any_value(a.n + b.n) as n, count(*) as c from u a join u b on a.x = b.x and a.id < b.id group by 1, 2) select a, b, round(c / (n - c), 3) as overlap from p where c * 5 >= 4 * (n - c)""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different titles (first lines, and each once more with a word added) whose words overlap by 0.8 or more: proposals only."""
    t = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").getItem(0).alias("t"))
    both = t.select((2 * F.col("doc_id")).alias("id"), "t").union(t.select(2 * F.col("doc_id") + 1, F.concat("t", F.lit(" revised"))))
    return cluster.similar_sets(both.select("id", text.tokens(F.col("t")).alias("words")), 0.8)


_ASKED = "a note on www.shop.net and its rules"
_EC = "case edge % 7 when 0 then upper(s.c_name) when 1 then t.c_name else s.c_name || ' bears on ' || t.c_name end"


@query(f"""with {_G}, m as (select doc_id, sha256(text) as h from documents), w as (select doc_id, case when doc_id % 23 = 4 then sha256(text || '!') else sha256(text) end as h from documents)
 select 'V-EDGE-02' as rule, cast(edge as varchar) as subject from e join customer s on s.c_custkey = e.source left join customer t on t.c_custkey = e.target where lower({_EC}) in (lower(s.c_name), lower(t.c_name))
 union all select 'V-WAVE-02', cast(doc_id as varchar) from w where h not in (select h from m) union all select 'V-SRC-05', cast(page_id as varchar) from (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as d from pages) where d <> '' and (page_id % 19 = 0 or contains('{_ASKED}', d) or len(list_intersect(list_filter(string_split(d, '.'), lambda x: x <> '' and x not in ('com', 'org', 'net', 'gov', 'edu', 'io', 'co', 'uk', 'us', 'int', 'ac')), regexp_extract_all('{_ASKED}', '[a-z0-9]+'))) > 0)""")
def rules_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that restate an end, merged texts that no member has, official or asked-for sources that an excerpt lacks."""
    from claimweave.operators import ledger

    c = load(spark, sf_dir, "customer")
    name = lambda end: c.select(F.col("c_custkey").alias(end), F.col("c_name").alias(f"{end}_claim"))
    e = edges(spark, sf_dir).join(name("source"), "source").join(name("target"), "target", "left")
    claim = F.when(F.col("edge") % 7 == 0, F.upper("source_claim")).when(F.col("edge") % 7 == 1, F.col("target_claim")).otherwise(F.concat("source_claim", F.lit(" bears on "), "target_claim"))
    restated = F.coalesce(F.lower(claim) == F.lower("source_claim"), F.lit(False)) | F.coalesce(F.lower(claim) == F.lower("target_claim"), F.lit(False))
    d = load(spark, sf_dir, "documents")
    merged = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 23 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    domain, tier = F.regexp_extract("url", "://([^/?#]*)", 1), F.when(F.col("page_id") % 19 == 0, "T1_official").otherwise("T5_press")
    wanted = load(spark, sf_dir, "pages").where(domain != "").select("page_id", ledger.matches_facet(domain, F.lit(""), tier, F.lit(_ASKED)).alias("wanted"))
    return audit(violation(e, "V-EDGE-02", "edge", restated), dangling(merged, "V-WAVE-02", "doc_id", "h", d.select(F.sha2("text", 256).alias("h")), "h"), violation(wanted, "V-SRC-05", "page_id", F.col("wanted")))


@query("""with p as (select s_suppkey as lane, case when s_suppkey % 8 = 2 then s_suppkey + 1 when s_suppkey % 8 = 3 then s_suppkey - 1 when s_suppkey % 4 = 1 then s_suppkey // 2 when s_suppkey % 28 = 0 then s_suppkey + 100000000 end as dep, s_acctbal > 0 as complete from supplier), x as (select p.*, d.lane as found, d.dep as onward, d.complete as dep_complete from p left join p d on d.lane = p.dep),
 w as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ('and', 'the', 'for'))) as a, list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, item_id % 200 + 1)), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ('and', 'the', 'for'))) as b from benchmark)
 select 'V-SPEC-03' as rule, cast(lane as varchar) as subject from x where dep is not null and (found is null or coalesce(onward = lane, false)) union all select 'V-EXP-07', cast(lane as varchar) from x where dep is not null and not coalesce(dep_complete, false)
 union all select 'V-COV-05', cast(item_id as varchar) from w where len(a) > 0 and ((len(a) + len(b) - 2 * len(list_intersect(a, b))) * 2 > len(a) + len(b)) <> (item_id % 2 = 0)
 union all select 'V-FRZ-04', cast(c_nationkey as varchar) from customer group by c_nationkey having not (bool_or(c_mktsegment = 'MACHINERY') and bool_or(c_acctbal > 9900) and count(*) >= 4)""")
def rules_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with a lane that waits for none or for itself, lanes begun before those they need, resets that the words do not bear out, freezes whose checklist fails."""
    p = load(spark, sf_dir, "supplier").selectExpr("s_suppkey as lane", "case when s_suppkey % 8 = 2 then s_suppkey + 1 when s_suppkey % 8 = 3 then s_suppkey - 1 when s_suppkey % 4 = 1 then s_suppkey div 2 when s_suppkey % 28 = 0 then s_suppkey + 100000000 end as dep", "s_acctbal > 0 as complete").where("dep is not null")
    lanes = load(spark, sf_dir, "supplier").selectExpr("s_suppkey as dep", "s_suppkey as found", "s_acctbal > 0 as dep_complete")
    x = p.join(lanes, "dep", "left")
    looped = graph.cyclic(p.selectExpr("lane as source", "dep as target")).select(F.col("source").alias("lane")).withColumn("looped", F.lit(True))
    x = x.join(looped.distinct(), "lane", "left")
    stop = ["and", "the", "for"]
    w = load(spark, sf_dir, "benchmark").select("item_id", text.core_terms(F.col("text"), stop).alias("a"), text.core_terms(F.expr("substring(text, 1, cast(item_id % 200 + 1 as int))"), stop).alias("b"))
    spine = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.bool_or(F.col("c_mktsegment") == "MACHINERY") & F.bool_or(F.col("c_acctbal") > 9900) & (F.count(F.lit(1)) >= 4)).alias("passed"))
    return audit(violation(x, "V-SPEC-03", "lane", F.col("found").isNull() | F.coalesce("looped", F.lit(False))), violation(x, "V-EXP-07", "lane", ~F.coalesce("dep_complete", F.lit(False))), violation(w, "V-COV-05", "item_id", (F.size("a") > 0) & (text.far_apart(F.col("a"), F.col("b")) != (F.col("item_id") % 2 == 0))), violation(spine, "V-FRZ-04", "c_nationkey", ~F.col("passed")))


@query("""with s as (select article, cast(k as int) as place, 'Part ' || k as title, (k + article) % 4 <> 0 as there from (select page_id as article, unnest(range(1, 4)) as k from pages)), d as (select article, string_agg('## ' || title || chr(10) || chr(10) || 'prose ' || article || '.' || place || chr(10), chr(10) order by place) filter (there) as body, coalesce(string_agg(title, ',' order by place) filter (not there), '') as skipped from s group by article),
 c as (select o_custkey as article, array_to_string(list_transform(list_sort(list_distinct(list(o_orderkey))), lambda x: '- [' || x || ']'), chr(10)) as refs from orders group by o_custkey)
 select page_id as article, '# ' || url || chr(10) || chr(10) || coalesce(d.body, '') || case when refs is null then '' else chr(10) || '## References' || chr(10) || chr(10) || refs || chr(10) end as body, skipped from pages join d on d.article = page_id left join c on c.article = page_id where url is not null""")
def article_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, the sections that have prose in the outline's order, those skipped, the distinct references in order."""
    p = load(spark, sf_dir, "pages").where("url is not null").select(F.col("page_id").alias("article"), "url")
    s = p.select("article", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("place")).withColumn("title", F.concat(F.lit("Part "), "place")).withColumn("there", (F.col("place") + F.col("article")) % 4 != 0)
    prose = F.concat(F.lit("## "), "title", F.lit("\n\nprose "), "article", F.lit("."), "place", F.lit("\n"))
    listed = lambda c, v, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("place", v.alias("v"))))), lambda x: x["v"]), sep)
    body = s.groupBy("article").agg(listed(F.col("there"), prose, "\n").alias("prose"), listed(~F.col("there"), F.col("title"), ",").alias("skipped"))
    refs = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("article")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("o_orderkey")), lambda x: F.concat(F.lit("- ["), x.cast("string"), F.lit("]"))), "\n").alias("refs"))
    tail = F.when(F.col("refs").isNull(), "").otherwise(F.concat(F.lit("\n## References\n\n"), "refs", F.lit("\n")))
    return p.join(body, "article").join(refs, "article", "left").select("article", F.concat(F.lit("# "), "url", F.lit("\n\n"), "prose", tail).alias("body"), "skipped")


_PATCHES = """case event_id % 4 when 0 then '{"x": {"y": null, "w": 5}}' when 1 then '{"k": null, "x": {"z": {"q": null, "r": 1}}}' when 2 then '{"x": 7}' else '{"n": {"m": null}}' end"""
_TARGET = """replace(props, '}', ', "x": {"y": 1, "z": 2}}')"""
_AT = ("k", "x", "x.y", "x.z.r", "x.w", "n.m")


@query(f"with p as (select event_id, json_merge_patch({_TARGET}::json, ({_PATCHES})::json) as j from events) select event_id, " + ", ".join(f"json_extract(j, '$.{a}') is not null as has_{a.replace('.', '_')}" for a in _AT) + ", json_extract_string(j, '$.k') as k, json_extract_string(j, '$.x.z.r') as r from p")
def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings under a patch: what is left, what is new."""
    e = load(spark, sf_dir, "events").selectExpr("event_id", f"{_TARGET} as target", f"{_PATCHES} as patch")
    p = e.select("event_id", text_udf.rowwise(text_udf.merge_patch, "target", "patch").alias("j"))
    at = lambda a: F.get_json_object("j", f"$.{a}")
    return p.select("event_id", *[at(a).isNotNull().alias(f"has_{a.replace('.', '_')}") for a in _AT], at("k").alias("k"), at("x.z.r").alias("r"))


#: table, id, and which column is hot as state, status, strength, queue_name and kind
INDEXED = [("customer", "c_custkey", {"state": "c_mktsegment"}), ("orders", "o_orderkey", {"status": "o_orderstatus", "queue_name": "o_orderpriority"}), ("events", "event_id", {"kind": "event_type"}), ("part", "p_partkey", {"kind": "p_type", "strength": "p_brand"}), ("documents", "doc_id", {"kind": "lang", "state": "source"})]
_HOT = ("state", "status", "strength", "queue_name", "kind")


def _indexed(table: str, key: str, hot: dict[str, str]) -> str:
    return f"select '{table}' as name, cast({key} as {{0}}) as id, " + ", ".join(f"{hot.get(c, 'cast(null as {0})')} as {c}" for c in _HOT) + f" from {table}"


@query(" union all ".join(_indexed(*t) for t in INDEXED).format("varchar"))
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all tables in one shape, with the columns that lists filter by."""
    for table, _, _ in INDEXED:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(" union all ".join(_indexed(*t) for t in INDEXED).format("string"))


AT_REST = ["rules_xref", "rules_restatement", "rules_lanes", "rules_source", "rules_task", "rules_wave"]


@query("select rule, cast(count(*) as bigint) as n from (" + " union all ".join(f"select * from ({ORACLES[r]})" for r in AT_REST) + ") group by rule")
def verify_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules about stored tables together: how often each is broken."""
    return audit(*[QUERIES[r](spark, sf_dir) for r in AT_REST]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))

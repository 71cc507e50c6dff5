"""Queries about the spine of a graph and its checklists. Nodes are customers (edge from i to i div 2, and for every third to (7 i + 1) mod 400), work items are orders, expansions are suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import spine
from claimweave.operators.graph import cyclic
from claimweave.operators.rules import audit, violation
from claimweave.plans.registry import query
from claimweave.plans.rules_plans import records, table, union_sql
from claimweave.plans.sentence_plans import _DP, doc_periods
from claimweave.plans.status_plans import q
from claimweave.sources.log import canonical
from claimweave.sources.tables import load

NODES = """select c_custkey as id, case when c_custkey = 0 then 'question' when c_custkey = 1 then 'thesis' when c_custkey % 4 = 0 then 'alternative' when c_custkey % 4 = 1 then 'mechanism' when c_custkey % 4 = 2 then 'fact' else 'bridge' end as node_type,
 case when c_custkey < 4 then 'active' when c_mktsegment = 'MACHINERY' then 'rejected' when c_mktsegment = 'AUTOMOBILE' then 'parked' when c_acctbal < -900 then 'candidate' else 'active' end as state, case when c_acctbal > 0 then 'absorbed' else 'other' end as reason, c_nationkey as lane, c_custkey % 3 as layer from customer"""
EDGES = """select id + 1000000000 as id, source, target, case when id % 5 = 4 then 'refutes' when id % 5 = 3 then 'depends_on' else 'supports' end as edge_type, case when id % 13 = 7 then 'rejected' else 'active' end as state
 from (select 2 * c_custkey as id, c_custkey as source, {half} as target from customer where c_custkey > 0 union all select 2 * c_custkey + 1, c_custkey, (7 * c_custkey + 1) % 400 from customer where c_custkey % 3 = 0)"""
ITEMS = "select o_custkey as target, case o_orderstatus when 'F' then 'committed' when 'O' then 'cancelled' else 'queued' end as status, o_orderkey from orders"
_G = f"n as materialized ({NODES}), e as materialized ({EDGES.format(half='c_custkey // 2')}), live as (select * from e where state = 'active' and edge_type in ('supports', 'depends_on')), act as (select id from n where state = 'active')"
_WALK = _G + ", w as (select cast(1 as bigint) as node union select source from w join live on target = node where source in (select id from act))"
_SPINE = _WALK + ", sn as (select node as id from w union select 0), se as (select id from live where target in (select node from w) and source in (select id from act) union select min(id) from live where source = 1 and target = 0 and edge_type = 'supports' having count(*) > 0)"


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(NODES), spark.sql(EDGES.format(half="c_custkey div 2"))


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(ITEMS)


@query(f"with recursive {_SPINE} select 'node' as kind, id from sn union all select 'edge', id from se")
def spine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine: from the one thesis back over all active edges with active sources."""
    return spine.spine(*graph_of(spark, sf_dir))


@query(f"with recursive {_SPINE} select 'node' as kind, id from sn union all (select 'edge', id from live where target in (select node from w) union select 'edge', id from se)")
def freeze_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What freezing the spine takes in: edges from sources that are not active too."""
    return spine.freeze(*graph_of(spark, sf_dir))


_LANES = "x as (select distinct s_nationkey as lane from supplier where s_acctbal > 4000), it as (select target, status from (" + ITEMS + ")), op as (select distinct target from it where status = 'queued' and target % 9 = 4), lr as (select lane, id from n union all select lane, e.id from e join n on n.id = e.source), lc as (select n_nationkey as lane, n_nationkey in (select lane from x) and n_nationkey not in (select lane from lr where id in (select target from op)) as complete from nation)"


def lanes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph_of(spark, sf_dir)
    expansions = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lane"), F.when(F.col("s_acctbal") > 4000, 0).otherwise(3).alias("added"))
    lanes = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lane"))
    return spine.lanes_complete(lanes, expansions, n, e, items_of(spark, sf_dir).where("target % 9 = 4"))


@query(f"with {_G}, {_LANES} select lane, complete from lc")
def lanes_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes whose closing expansion has come and that no open item is on."""
    return lanes_of(spark, sf_dir)


_SWEEP = "sd as (select id from n where layer = 0 and node_type in ('fact', 'mechanism') and state <> 'rejected'), rq as (select o_custkey as id, count(distinct l_linenumber * 1000000 + l_orderkey) as units, count(distinct l_partkey) as docs from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1), nf as (select o_custkey as id, count(*) as lost from orders where o_orderpriority = '5-LOW' group by 1), sw as (select sd.id as id, coalesce(units >= 2 and docs >= 2, false) or coalesce(lost, 0) >= 2 as met from sd left join rq on rq.id = sd.id left join nf on nf.id = sd.id)"


def sweeps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    requested = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("target"), (F.col("l_linenumber") * 1000000 + F.col("l_orderkey")).alias("unit"), F.col("l_partkey").alias("doc"))
    return spine.sweep_floor(graph_of(spark, sf_dir)[0], requested, o.select(F.col("o_custkey").alias("target"), F.when(F.col("o_orderpriority") == "5-LOW", "not_found").otherwise("fulfilled").alias("status")))


@query(f"with {_G}, {_SWEEP} select id, met from sw")
def sweep_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed claims and whether enough was sought for each: two units from two documents, or two searches in vain."""
    return sweeps_of(spark, sf_dir)


@query(f"""with recursive {_SPINE}, {_LANES}, {_SWEEP}, pr as (select n.* from n join sn on sn.id = n.id where node_type in ('fact', 'mechanism')), be as (select id from sn union select id from se union select id from e where source in (select id from sn) or target in (select id from sn))
 select 'MSA-1' as item, true as pass union all select 'MSA-2', count(*) > 0 from e where source = 1 and target = 0 and edge_type = 'supports' and id in (select id from se) union all select 'MSA-3', true
 union all select 'MSA-4', coalesce(bool_and(coalesce(sw.met, false)), true) from pr left join sw on sw.id = pr.id union all select 'MSA-5', coalesce(bool_and(state = 'rejected' or (state = 'parked' and reason = 'absorbed')), true) from n where node_type = 'alternative'
 union all select 'MSA-6', count(*) = 0 from op where target in (select id from be) union all select 'MSA-7', coalesce(bool_and(complete), true) and count(*) > 0 from lc union all select 'MSA-8', count(*) = 0 from part where p_size > 49 union all select 'MSA-9', coalesce(bool_or(state = 'active'), false) from pr""")
def msa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine conditions of a minimal structure over the spine."""
    n, e = graph_of(spark, sf_dir)
    gaps = load(spark, sf_dir, "part").where("p_size > 49")
    return spine.checklist(n, e, sweeps_of(spark, sf_dir), items_of(spark, sf_dir).where("target % 9 = 4"), lanes_of(spark, sf_dir), gaps)


CRITIC, CRITIC_SQL = table({"keys": ["'form'", "'form'", "'form,documents'", "'form,evidence_units'"], "official": q("yes", "tried_empty", "maybe", None, often=3), "academic": q("yes", "no_attempt", "tried_blocked"), "counter": q("yes", "tried_empty", None, often=4), "news": q("yes", "odd", None, often=4), "primary_source": q("yes", "no", "n/a", "perhaps"), "disconfirming": q("yes", "no", "n/a"), "expected": ["0", "1", "3", "4"]}, 400)
_ANGLES = "('yes', 'tried_empty', 'tried_blocked', 'no_attempt')"


@query(union_sql(CRITIC_SQL, [("V-WAVE-03", f"keys <> 'form' or coalesce(official not in {_ANGLES}, true) or coalesce(academic not in {_ANGLES}, true) or coalesce(counter not in {_ANGLES}, true) or coalesce(news not in {_ANGLES}, false) or primary_source not in ('yes', 'no', 'n/a') or disconfirming not in ('yes', 'no', 'n/a') or expected > 3")]))
def rules_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critics that hand in evidence, leave a mandatory angle unanswered, answer outside the lists, or ask for more than three sources."""
    f = records(spark, sf_dir, CRITIC)
    known = lambda c, values, absent: F.coalesce(F.col(c).isin(*values), F.lit(absent))
    angle, presence = ("yes", "tried_empty", "tried_blocked", "no_attempt"), ("yes", "no", "n/a")
    sound = F.size(F.array_intersect(F.split("keys", ","), F.array(F.lit("documents"), F.lit("evidence_units")))) == 0
    for c in ("official", "academic", "counter"):
        sound &= known(c, angle, False)
    sound &= known("news", angle, True) & known("primary_source", presence, False) & known("disconfirming", presence, False) & (F.col("expected") <= 3)
    return audit(violation(f, "V-WAVE-03", "id", ~sound))


CONTRACT = ("1930–1990", ["src1", "SRC2", "src3"])
_IN = "(d.period is null or case when d.ys is not null then list_min(d.ys) <= 1990 and 1930 <= list_max(d.ys) else false end) and (source is null or lower(source) in ('src1', 'src2', 'src3'))"
_CLAIM = "trim(substr(text, 1, 150)) || case when doc_id % 17 = 3 then ', which means more' else '' end"
_COUNT = "len(list_filter(list_transform(string_split(regexp_replace(c, '([.!?])(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''))"


@query(f"""with recursive {_DP}, {_G}, cl as (select doc_id, {_CLAIM} as c from documents where text is not null), v as (select 'V-NODE-03' as rule, cast(doc_id as varchar) as subject from d where not ({_IN}) union all select 'V-EXP-05', cast(cl.doc_id as varchar) from cl where {_COUNT} not between 1 and 2 or contains(lower(c), '; and') or contains(lower(c), 'and therefore') or contains(lower(c), 'which means')
  union all select 'V-EXP-05', cast(doc_id as varchar) from d where not ({_IN})), x as (select id, source, target from e where state <> 'rejected' and edge_type in ('supports', 'depends_on')), r as (select source, target from x union select r.source, x.target from r join x on x.source = r.target), cyc as (select distinct source as node from r where source = target),
  fr as (select node from cyc union select target from r where source in (select node from cyc)), bk as (select node from cyc union select source from r where target in (select node from cyc))
 select * from v union all select 'V-GRAPH-01', cast(id as varchar) from x where source in (select node from fr) and target in (select node from bk)""")
def rules_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes outside the contract's scope, proposals that are no single claim within it, and edges on the cycles of the support graph (or between two)."""
    d = doc_periods(spark, sf_dir)
    none = F.lit(None).cast("string")
    inside = text.scope_compatible(F.col("period"), F.lit(CONTRACT[0]), none, none, F.when(F.col("source").isNotNull(), F.array("source")), F.array(*map(F.lit, CONTRACT[1])))
    claims = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(_CLAIM).alias("claim"))
    low = F.lower("claim")
    single = F.size(text.sentences(F.col("claim"))).between(1, 2) & ~F.contains(low, F.lit("; and")) & ~F.contains(low, F.lit("and therefore")) & ~F.contains(low, F.lit("which means"))
    e = graph_of(spark, sf_dir)[1].where("state <> 'rejected' and edge_type in ('supports', 'depends_on')")
    ahead = cyclic(e.select("source", "target"))
    both = cyclic(ahead.select(F.col("target").alias("source"), F.col("source").alias("target"))).select(F.col("target").alias("source"), F.col("source").alias("target"))
    looped = e.join(both, ["source", "target"], "left_semi").withColumn("looped", F.lit(True))
    return audit(violation(d, "V-NODE-03", "doc_id", ~inside), violation(claims, "V-EXP-05", "doc_id", ~single), violation(d, "V-EXP-05", "doc_id", ~inside), violation(looped, "V-GRAPH-01", "id", F.col("looped")))


@query("""select c_custkey as node, '{"lane":' || c_nationkey || ',"name":"' || c_name || '","node":' || c_custkey || ',"parent":' || case when c_custkey = 0 then 'null' else cast(c_custkey // 3 as varchar) end || '}' as json from customer""")
def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the tree as canonical JSON, keys in order, nulls written."""
    n = load(spark, sf_dir, "customer").selectExpr("c_custkey as node", "case when c_custkey > 0 then c_custkey div 3 end as parent", "c_nationkey as lane", "c_name as name")
    return n.select("node", canonical("node", "parent", "lane", "name").alias("json"))

"""Queries about graphs, trees, clusters and references, bound to customers, orders and documents.

Nodes are customers: the parent of node i is i div 3; edges go from i to i div 2 and to (7 i + 1) mod 400; customers of one market
segment are rejected records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import cluster, current, graph
from claimweave.plans.registry import query
from claimweave.sources.tables import load

_G = """n as (select c_custkey as node, case when c_custkey > 0 then c_custkey // 3 end as parent, c_mktsegment = 'MACHINERY' as rejected, c_nationkey as lane from customer),
e as (select 2 * c_custkey as edge, c_custkey as source, c_custkey // 2 as target from customer union all select 2 * c_custkey + 1, c_custkey, (7 * c_custkey + 1) % 400 from customer where c_custkey % 3 = 0)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr("c_custkey as node", "case when c_custkey > 0 then c_custkey div 3 end as parent", "c_mktsegment = 'MACHINERY' as rejected", "c_nationkey as lane")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.selectExpr("2 * c_custkey as edge", "c_custkey as source", "c_custkey div 2 as target").union(c.where("c_custkey % 3 = 0").selectExpr("2 * c_custkey + 1", "c_custkey", "(7 * c_custkey + 1) % 400"))


@query(f"with recursive {_G}, r as (select node from (values (77), (93)) v(node) union select target from r join e on e.source = r.node where target not in (select node from n where rejected)) select node from r")
def spine_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([(77,), (93,)], "node long")
    return graph.closure(start, edges(spark, sf_dir).select("source", "target"), nodes(spark, sf_dir).where("rejected").select("node")).select("node")


@query(f"with recursive {_G}, r as (select node from (values (77), (93)) v(node) union select target from r join e on e.source = r.node where target not in (select node from n where rejected)) select 'node' as kind, node as id from r union all select 'edge', edge from e where source in (select node from r)")
def freeze_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walk, but an edge is taken in before its end is tested."""
    found = spine_closure(spark, sf_dir)
    own = edges(spark, sf_dir).join(found.withColumnRenamed("node", "source"), "source", "left_semi")
    return found.select(F.lit("node").alias("kind"), F.col("node").alias("id")).union(own.select(F.lit("edge"), "edge"))


@query(f"with {_G} select node, near from (select source as node, target as near from e union select target, source from e) where node <> near and node in (select node from n where not rejected)")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_hop(nodes(spark, sf_dir).where("not rejected"), edges(spark, sf_dir))


@query(f"""with {_G}, c as (select node from n where lane = 4 and rejected) select 'node' as kind, node as id from n where node in (select node from c) or parent in (select node from c)
 union select 'edge', edge from e where source in (select node from c) or target in (select node from c)""")
def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.touched(n, edges(spark, sf_dir), n.where("lane = 4 and rejected").select("node"))


@query("""with recursive e as (select c_custkey as s, c_custkey // 2 as t from customer where c_custkey >= 1 union select c_custkey, (7 * c_custkey + 1) % 100 from customer where c_custkey % 3 = 0),
 x as (select s as source, t as target from e where s <> t), r as (select source, target from x union select r.source, x.target from r join x on x.source = r.target), back as (select distinct source as node from r where source = target)
 select x.source, x.target from x where x.target in (select node from back) or exists (select 1 from r where r.source = x.target and r.target in (select node from back))""")
def cycle_check_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from which a cycle can be reached: what is left when nodes without outgoing edges are peeled off."""
    c = load(spark, sf_dir, "customer")
    e = c.where("c_custkey >= 1").selectExpr("c_custkey as source", "c_custkey div 2 as target").union(c.where("c_custkey % 3 = 0").selectExpr("c_custkey", "(7 * c_custkey + 1) % 100")).where("source <> target").distinct()
    return graph.cyclic(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).select(F.col("target").alias("source"), F.col("source").alias("target"))


@query("select cast(0 as bigint) as n_cyclic")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halving edges alone are a DAG."""
    e = load(spark, sf_dir, "customer").where("c_custkey >= 1").selectExpr("c_custkey as source", "c_custkey div 2 as target")
    return graph.cyclic(e).agg(F.count(F.lit(1)).alias("n_cyclic"))


_TREE = f"with recursive {_G}, p as (select node, 0 as depth, cast(node as varchar) as path from n where parent is null union all select n.node, depth + 1, path || '/' || n.node from n join p on n.parent = p.node)"


@query(_TREE + " select node, depth, path from p")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(nodes(spark, sf_dir)).select("node", "depth", F.array_join("path", "/").alias("path"))


@query(_TREE + """, o as (select o_orderkey, o_custkey, (o_orderkey * 11 + 5) % 120 as other from orders)
 select o_orderkey, case when a.path = b.path then 0 when starts_with(b.path, a.path || '/') then 1 when starts_with(a.path, b.path || '/') then 2 when a.depth = b.depth and a.depth > 0 and regexp_replace(a.path, '/\\d+$', '') = regexp_replace(b.path, '/\\d+$', '') then 3 else 4 end as distance
 from o join p a on a.node = o.o_custkey join p b on b.node = o.other""")
def tree_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).select("o_orderkey", graph.distance_class(F.col("path"), F.col("up"), F.col("path2"), F.col("up2")).alias("distance"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nodes of each order, with their paths and their parents' paths as strings."""
    joined = F.array_join("path", "/")
    p = graph.cut(graph.paths(nodes(spark, sf_dir)).select("node", joined.alias("path"), F.expr("case when depth > 0 then substring_index(array_join(path, '/'), '/', depth) end").alias("up")))
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as node", "(o_orderkey * 11 + 5) % 120 as other")
    return o.join(p, "node").join(p.select(F.col("node").alias("other"), F.col("path").alias("path2"), F.col("up").alias("up2")), "other")


@query(_TREE + ", d as (select p.node, max(list_position(string_split(p.path, '/'), cast(n.node as varchar))) as place from p join n on n.rejected and n.node <> p.node and list_contains(string_split(p.path, '/'), cast(n.node as varchar)) group by p.node) select d.node as node, cast(string_split(p.path, '/')[place] as bigint) as dead from d join p on p.node = d.node")
def nearest_dead_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graph.paths(nodes(spark, sf_dir)).select("node", F.posexplode("path").alias("at", "up")).where("node <> up")
    dead = nodes(spark, sf_dir).where("rejected").select(F.col("node").alias("up"))
    return p.join(dead, "up").groupBy("node").agg(F.max_by("up", "at").alias("dead"))


@query(f"""with {_G}, k as (select parent, count(*) as kids, count(*) filter (not rejected) as live from n where parent is not null group by parent)
 select 'wide' as rule, parent as node from k where kids > 3 union all select 'childless' as rule, node from n left join k on k.parent = n.node where kids is null and not rejected union all
 select 'orphan', n.node from n join n p on p.node = n.parent where p.rejected and not n.rejected union all select 'no_live_child', parent from k where live = 0""")
def tree_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    k = n.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.count(F.when(~F.col("rejected"), 1)).alias("live"))
    named = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("node"))
    dead = n.where("rejected").select(F.col("node").alias("parent"))
    return named(k.where("kids > 3"), "wide", "parent").union(named(n.where("not rejected").join(k.select(F.col("parent").alias("node")), "node", "left_anti"), "childless", "node")).union(
        named(n.where("not rejected").join(dead, "parent", "left_semi"), "orphan", "node")).union(named(k.where("live = 0"), "no_live_child", "parent"))


@query("select o_orderkey, l_linenumber, p_name as title, p_partkey is not null as resolved from orders join lineitem on l_orderkey = o_orderkey left join (select * from part where p_partkey % 10 <> 3) on p_partkey = l_partkey where o_orderstatus = 'F'")
def trace_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's bindings with what they resolve to; the unresolved stay."""
    p = load(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.lit(True).alias("known"))
    b = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey")
    return b.join(p, "l_partkey", "left").select("o_orderkey", "l_linenumber", "title", F.coalesce("known", F.lit(False)).alias("resolved"))


@query("select 'order-customer' as reference, cast(o_orderkey as varchar) as subject from orders where o_custkey not in (select c_custkey from customer where c_custkey % 50 <> 7) union all select 'line-part', l_orderkey || '-' || l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 100 <> 9)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").where("c_custkey % 50 <> 7").select(F.col("c_custkey").alias("o_custkey"))
    p = load(spark, sf_dir, "part").where("p_partkey % 100 <> 9").select(F.col("p_partkey").alias("l_partkey"))
    a = load(spark, sf_dir, "orders").join(c, "o_custkey", "left_anti").select(F.lit("order-customer").alias("reference"), F.col("o_orderkey").cast("string").alias("subject"))
    return a.union(load(spark, sf_dir, "lineitem").join(p, "l_partkey", "left_anti").select(F.lit("line-part"), F.concat("l_orderkey", F.lit("-"), "l_linenumber")))


@query("select l_partkey as unit, cast(count(distinct l_orderkey) as bigint) as n, min(l_orderkey) as first, max(l_orderkey) as last from lineitem group by l_partkey")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.countDistinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("""select 'spine' as gap, cast(c_custkey as varchar) as target from customer where c_custkey % 13 = 0 and not exists (select 1 from orders where o_custkey = c_custkey) union all select 'unquoted', cast(p_partkey as varchar) from part where not exists (select 1 from lineitem where l_partkey = p_partkey)
 union all select 'unsupplied', cast(s_suppkey as varchar) from supplier where s_acctbal < 0 union all select 'open', cast(o_orderkey as varchar) from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' union all select 'unlabelled', cast(doc_id as varchar) from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)""")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    named = lambda df, gap, c: df.select(F.lit(gap).alias("gap"), F.col(c).cast("string").alias("target"))
    a = named(t("customer").where("c_custkey % 13 = 0").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "spine", "c_custkey")
    b = named(t("part").join(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "unquoted", "p_partkey")
    c = named(t("supplier").where("s_acctbal < 0"), "unsupplied", "s_suppkey")
    d = named(t("orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"), "open", "o_orderkey")
    return a.union(b).union(c).union(d).union(named(t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti"), "unlabelled", "doc_id"))


@query("(select 'open' as action, doc_id from (select doc_id from documents where lang = 'en' except select doc_id from labels)) union all (select 'close', doc_id from (select doc_id from labels except select doc_id from documents where lang = 'en'))")
def gap_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    want, have = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id")
    return want.join(have, "doc_id", "left_anti").distinct().select(F.lit("open").alias("action"), "doc_id").union(have.join(want, "doc_id", "left_anti").distinct().select(F.lit("close"), "doc_id"))


_MSA = f"with {_G}, l as (select lane, count(*) as n, bool_and(not rejected) as all_live, count(*) filter (rejected) as dead, bool_or(node % 17 = 0) as has_thesis, max(node) as newest from n group by lane)"


@query(_MSA + " select lane, n = 0 or all_live as live, dead <= n / 4 as mostly_live, has_thesis, n > 0 and newest % 2 = 0 as even_end from l")
def msa_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.bool_and(~F.col("rejected")).alias("live"), F.count(F.when(F.col("rejected"), 1)).alias("dead"), F.bool_or(F.col("node") % 17 == 0).alias("has_thesis"), F.max("node").alias("newest"))
    return n.select("lane", "live", (F.col("dead") <= F.col("n") / 4).alias("mostly_live"), "has_thesis", (F.col("newest") % 2 == 0).alias("even_end"))


@query("select n_nationkey as lane, exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000) and not exists (select 1 from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey and o_orderstatus = 'O' and o_totalprice > 480000) as complete from nation")
def lane_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("lane"), F.lit(True).alias("closed")).distinct()
    busy = load(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey")).join(load(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_nationkey").alias("lane"), F.lit(True).alias("busy")).distinct()
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lane")).join(closing, "lane", "left").join(busy, "lane", "left")
    return n.select("lane", (F.coalesce("closed", F.lit(False)) & ~F.coalesce("busy", F.lit(False))).alias("complete"))


@query("select o_custkey as target, (count(*) filter (o_orderstatus = 'F') >= 2 and count(distinct o_orderpriority) filter (o_orderstatus = 'F') >= 2) or count(*) filter (o_orderstatus = 'P') >= 2 as floor from orders group by o_custkey")
def sweep_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("target")).agg(F.count(F.when(f, 1)).alias("a"), F.countDistinct(F.when(f, F.col("o_orderpriority"))).alias("b"), F.count(F.when(p, 1)).alias("c"))
    return rows.select("target", (((F.col("a") >= 2) & (F.col("b") >= 2)) | (F.col("c") >= 2)).alias("floor"))


@query("""with c as (select 200 * conv_id + 2 * turn as id, text from conversations union all select 200 * conv_id + 2 * turn + 1, text || ' so it is' from conversations where conv_id % 7 = 0), s as (select min(id) as id, array_to_string(list_sort(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')), ',') as d, list_distinct(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i : i + 4])) as g from c group by text),
 p as (select a.id as a, b.id as b, len(list_intersect(a.g, b.g)) as i, len(a.g) as n, len(b.g) as m from s a join s b on a.id < b.id and a.d = b.d and len(a.g) > 0 and len(b.g) > 0 and least(len(a.g), len(b.g)) >= 0.82 * greatest(len(a.g), len(b.g)))
 select a, b, round(i / (n + m - i), 6) as jaccard from p where i / (n + m - i) >= 0.82""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-equal turns; some turns stand once more with a few words added."""
    c, id = load(spark, sf_dir, "conversations"), 200 * F.col("conv_id") + 2 * F.col("turn")
    refs = c.select(id.alias("id"), "text").union(c.where("conv_id % 7 = 0").select(id + 1, F.concat("text", F.lit(" so it is"))))
    return cluster.near_duplicates(cluster.distinct_texts(refs), texts=refs).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-equal documents, copies too, where all pairs are too many for SQL; tests hold it against brute force."""
    refs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return cluster.near_records(refs).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("""with recursive s as (select doc_id, sha256(text) as h, case when n_chars % 97 = 0 then lang || source end as up from documents), e as (select a.doc_id as x, min(b.doc_id) as y from s a join s b on a.h = b.h group by a.doc_id union select a.doc_id, min(b.doc_id) from s a join s b on a.up = b.up group by a.doc_id),
 u as (select x, y from e where x <> y union select y, x from e where x <> y), r as (select x, y from u union select r.x, u.y from r join u on u.x = r.y), m as (select x, min(y) as y from r group by x)
 select s.doc_id as doc_id, least(s.doc_id, coalesce(m.y, s.doc_id)) as root from s left join m on m.x = s.doc_id""")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by equal content and by a declared upstream."""
    refs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), F.when(F.col("n_chars") % 97 == 0, F.concat("lang", "source")).alias("up"))
    return cluster.independent(refs, [cluster.star(refs, "h", "content"), cluster.star(refs, "up", "upstream")]).select(F.col("id").alias("doc_id"), "root")


@query("""with w as (select distinct doc_id, unnest(list_filter(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda n: length(regexp_replace(replace(n, '.', ''), '^0+', '')) >= 3 and not regexp_full_match(n, '(19|20)\\d\\d') and n not in ('100', '50', '95', '99'))) as x from documents)
 select x as number, cast(count(*) as bigint) as docs, min(doc_id) as least from w group by x having count(*) > 1""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare numbers that several documents share (proposals only), one row a number instead of all pairs."""
    from claimweave.functions import text

    w = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.rare_numbers(F.col("text"))).alias("number"))
    return w.groupBy("number").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least")).where("docs > 1")


@query("""with p as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before, text from conversations)
 select 'same_role' as rule, conv_id, turn from p where before = role union all select 'empty', conv_id, turn from p where trim(text) = '' union all select 'starts_with_assistant', conv_id, turn from p where turn = 0 and role = 'assistant' union all select 'long', conv_id, turn from p where length(text) > 1500""")
def prose_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = load(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    named = lambda cond, rule: p.where(cond).select(F.lit(rule).alias("rule"), "conv_id", "turn")
    return named("before = role", "same_role").union(named("trim(text) = ''", "empty")).union(named("turn = 0 and role = 'assistant'", "starts_with_assistant")).union(named("length(text) > 1500", "long"))


@query("select lang, round(avg(length(text)), 4) as mean_chars, cast(sum(len(regexp_extract_all(text, '\\d+'))) as bigint) as numbers, cast(count(distinct source) as bigint) as sources from documents group by lang")
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.sum(n).alias("numbers"), F.countDistinct("source").alias("sources"))


@query("select source, round(avg(quality), 2) as mean_quality, round(avg(toxic), 2) as mean_toxic, cast(count(*) as bigint) as n from documents join labels using (doc_id) group by source")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(F.avg("quality"), 2).alias("mean_quality"), F.round(F.avg("toxic"), 2).alias("mean_toxic"), F.count(F.lit(1)).alias("n"))


@query("""with b as (select quality, true as b0, n_chars > 500 as b1, n_chars > 500 and toxic = 0 as b2 from documents join labels using (doc_id)), u as (select 'B0' as baseline, b0 as yes, quality from b union all select 'B1', b1, quality from b union all select 'B2', b2, quality from b)
 select baseline, cast(count(*) filter (yes = (quality = 1)) as bigint) as agree, cast(count(*) filter (yes and quality = 0) as bigint) as fp, cast(count(*) filter (not yes and quality = 1) as bigint) as fn from u group by baseline""")
def baseline_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    long = F.col("n_chars") > 500
    rows = d.select((F.col("quality") == 1).alias("good"), F.explode(F.create_map(F.lit("B0"), F.lit(True), F.lit("B1"), long, F.lit("B2"), long & (F.col("toxic") == 0))).alias("baseline", "yes"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("baseline").agg(n(F.col("yes") == F.col("good")).alias("agree"), n(F.col("yes") & ~F.col("good")).alias("fp"), n(~F.col("yes") & F.col("good")).alias("fn"))


@query("select item_id, case when n = 0 then 'absent' when n = 1 then 'unique' else 'shared' end as fidelity, cast(n as bigint) as n from (select item_id, count(doc_id) as n from benchmark b left join documents d on contains(d.text, b.text) group by item_id)")
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimweave.operators import retrieve

    items = load(spark, sf_dir, "benchmark").select("item_id", "text")
    found = retrieve.contained(items, load(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.when(n == 0, "absent").when(n == 1, "unique").otherwise("shared").alias("fidelity"), n.alias("n"))


_DIAG = {"0-required": "complete-record", "0-domain": "complete-record", "0-flag-driver": "refetch", "0a": "refetch", "0b": "stop", "0c": "find-other-source", "0d": "fix-quote", "0e": "counter-search", "0f": "stop", "0g": "run-gates", "2a": "stop", "2b": "more-independent-sources", "2c": "upgrade-evidence", "2d": "address-flags", "2d'": "address-flags", "2e": "stop"}


def _diagnose_sql() -> str:
    from claimweave.plans.status_plans import _S

    case = " ".join(f"when '{k.replace(chr(39), chr(39) * 2)}' then '{v}'" for k, v in _DIAG.items())
    last = """case when step <> 'end' then step when budget_state = 'degraded' then '2e' when regexp_matches(flag_list, 'F-(01|02|09|15|24|25)') then '2d''' when regexp_matches(f, ',(F-13|F-12|F-03|F-04),') then '2d' else '2c' end"""
    return _S + f"select id, at_step, case at_step {case} else 'none' end as remedy from (select id, {last} as at_step from k)"


@query(_diagnose_sql())
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remedy for the last step that acted (the intended reading; every record that ends normally names its last step too)."""
    from claimweave.operators.status import literal_map, with_status
    from claimweave.plans.status_plans import lines, vectors

    s = with_status(vectors(lines(spark, sf_dir))).withColumn("at_step", F.element_at("trace", -1))
    return s.select("id", "at_step", F.coalesce(literal_map(_DIAG)[F.col("at_step")], F.lit("none")).alias("remedy"))


@query("select a.c_custkey as id, a.c_nationkey <> b.c_nationkey or a.c_mktsegment <> b.c_mktsegment as stale from customer a join customer b on b.c_custkey = a.c_custkey + 1 and a.c_custkey % 2 = 0")
def input_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the signature that a bundle was made from is still that of the record (here: of the next record)."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("signature"))
    now = c.where("c_custkey % 2 = 1").select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("signature").alias("now"))
    return c.join(now, "c_custkey").select(F.col("c_custkey").alias("id"), (F.col("signature") != F.col("now")).alias("stale"))


@query(f"with {_G}, x as (select node from n where rejected) select 'edge' as kind, edge as id, 'rejected' as action from e where source in (select node from x) or target in (select node from x) union all select 'item', o_orderkey, 'cancelled' from orders where o_orderstatus = 'O' and o_custkey in (select node from x)")
def commit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rejection of nodes appends: their edges are rejected, their open items cancelled."""
    x = nodes(spark, sf_dir).where("rejected").select("node")
    e = edges(spark, sf_dir)
    hit = e.join(x.withColumnRenamed("node", "source"), "source", "left_semi").select("edge").union(e.join(x.withColumnRenamed("node", "target"), "target", "left_semi").select("edge")).distinct()
    items = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(x.withColumnRenamed("node", "o_custkey"), "o_custkey", "left_semi")
    return hit.select(F.lit("edge").alias("kind"), F.col("edge").alias("id"), F.lit("rejected").alias("action")).union(items.select(F.lit("item"), "o_orderkey", F.lit("cancelled")))


@query("""with p as (select o_orderkey as item, o_custkey as target, o_orderstatus as s from orders), m as (select c_custkey as id from customer where c_custkey % 40 = 0), near as (select c_custkey as target from customer where c_custkey in (select id from m) or c_custkey // 2 in (select id from m) or c_custkey in (select id // 2 from m))
 select item from p where s in ('O', 'P') and target in (select target from near)""")
def sibling_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    m = c.where("c_custkey % 40 = 0").select(F.col("c_custkey").alias("id"))
    near = m.union(c.selectExpr("c_custkey as id", "c_custkey div 2 as up").join(m.withColumnRenamed("id", "up"), "up", "left_semi").select("id")).union(m.select(F.expr("id div 2")).join(c.select(F.col("c_custkey").alias("(id div 2)")), "(id div 2)", "left_semi")).distinct()
    return load(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P')").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("id")).join(near, "id", "left_semi").select("item")


@query("select c_custkey as id, 'N-' || lpad(cast((select max(c_custkey) from customer) + row_number() over (order by c_custkey) as varchar), 8, '0') as new_id from customer")
def id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids for all records: the largest number and their place, zero-padded."""
    c = load(spark, sf_dir, "customer")
    top = c.agg(F.max("c_custkey").alias("top")).first()["top"]
    return current.numbered(c.select(F.col("c_custkey").alias("id")), "id").select("id", F.concat(F.lit("N-"), F.lpad((F.col("place") + F.lit(top)).cast("string"), 8, "0")).alias("new_id"))

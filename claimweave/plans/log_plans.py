"""Queries about logs, the work queue, costs and sources, bound to the events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.operators import current, ledger, workqueue
from claimweave.plans.registry import query
from claimweave.sources.tables import load

QUEUES = ["click", "view", "signup"]
#: The queue's log out of the events: each user is an item.
_TO = "case event_type when 'click' then 'claimed' when 'view' then 'running' when 'signup' then 'validating' when 'purchase' then 'queued' else 'failed' end"
_OP = "case event_type when 'click' then 'claim' when 'view' then 'heartbeat' when 'signup' then 'complete' when 'purchase' then case when event_id % 2 = 0 then 'release' else 'retry' end else 'fail' end"
_QLOG = f"""q0 as (select event_id, user_id as item, ts, {_OP} as op, {_TO} as to_status from events),
q as (select *, case when event_id % 11 = 0 then 'queued' else coalesce(lag(to_status) over (partition by item order by event_id), '-') end as from_status from q0)"""
_TABLE = "t as (select split_part(x, ' ', 1) as f, split_part(x, ' ', 2) as o, split_part(x, ' ', 3) as g from (select trim(unnest(string_split('" + " ".join(workqueue.TRANSITIONS.split()) + "', ','))) as x))"


def queue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").selectExpr("event_id", "user_id as item", "ts", f"{_OP} as op", f"{_TO} as to_status")
    before = F.coalesce(F.lag("to_status").over(Window.partitionBy("item").orderBy("event_id")), F.lit("-"))
    return e.withColumn("from_status", F.when(F.col("event_id") % 11 == 0, "queued").otherwise(before))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def latest_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("select event_id, event_type, value from events where user_id = 7")
def history_for_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("user_id = 7").select("event_id", "event_type", "value").orderBy("event_id")


@query("select user_id, min(event_id) as first_seq, cast(count(*) as bigint) as n from events group by user_id")
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.first_seen(load(spark, sf_dir, "events"), "user_id", "event_id")


@query("select event_id, user_id, event_type from events where event_id < 700 order by event_id desc limit 50")
def event_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50, the size being the feature."""
    return current.page(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 700, 50)


@query("select user_id, event_id, event_type, previous from (select *, lag(event_type) over (partition by user_id order by event_id) as previous from events) where previous <> event_type")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.changes(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'passed' end as status, event_type as kind from events")
def hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "passed")
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), status.alias("status"), F.col("event_type").alias("kind"))


@query("""with a as (select user_id, sha256(string_agg(event_type, ',' order by event_id)) as h from events where event_id % 3 <> 0 or user_id % 4 <> 0 group by user_id), b as (select user_id, sha256(string_agg(event_type, ',' order by event_id)) as h from events where user_id % 9 <> 0 group by user_id)
 select coalesce(a.user_id, b.user_id) as user_id, a.h as old, b.h as new, case when a.h is null then 'added' when b.h is null then 'removed' else 'changed' end as kind from a full join b on a.user_id = b.user_id where a.h is distinct from b.h""")
def stale_index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    digest = lambda df: df.groupBy("user_id").agg(F.sha2(F.array_join(listed, ","), 256).alias("h"))
    return current.snapshot_diff(digest(e.where("event_id % 3 <> 0 or user_id % 4 <> 0")), digest(e.where("user_id % 9 <> 0")), "user_id", "h")


@query("""with p as (select user_id, arg_max(event_type, event_id) as v from events where ts < timestamp '2024-01-15' group by user_id), z as (select user_id, arg_max(event_type, event_id) as v from events group by user_id),
 n as (select user_id, count(*) as n from events where ts >= timestamp '2024-01-15' group by user_id)
 select z.user_id as user_id, p.v as old, z.v as new, cast(coalesce(n.n, 0) as bigint) as actions, coalesce(n.n, 0) = 0 and p.v is distinct from z.v as unexplained from z left join p on p.user_id = z.user_id left join n on n.user_id = z.user_id""")
def snapshot_replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.when(cut, F.col("event_id"))).alias("old0"), F.count(F.when(cut, 1)).alias("n_old"), F.max_by("event_type", "event_id").alias("new"), F.count(F.when(~cut, 1)).alias("actions")).select(
        "user_id", F.when(F.col("n_old") > 0, F.col("old0")).alias("old"), "new", "actions", ((F.col("actions") == 0) & ~F.when(F.col("n_old") > 0, F.col("old0")).eqNullSafe(F.col("new"))).alias("unexplained"))


@query("""with c as (select o_orderpriority as queue, o_orderstatus as status, count(*) as n from orders group by all), a as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) as queue), b as (select unnest(['O', 'F', 'P', 'X']) as status)
 select a.queue as queue, b.status as status, cast(coalesce(n, 0) as bigint) as n from a cross join b left join c on c.queue = a.queue and c.status = b.status""")
def queue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderstatus").alias("status"))
    return workqueue.matrix(items, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["O", "F", "P", "X"])


@query("""select coalesce(c_mktsegment, 'unknown') as agent, cast(count(*) as bigint) as items, cast(count(*) filter (o_orderstatus = 'O') as bigint) as open, cast(count(*) filter (o_orderstatus = 'P') as bigint) as working,
 cast(count(*) filter (o_orderstatus = 'F') as bigint) as committed, min(o_orderkey) filter (o_orderstatus = 'O') as next_item from orders left join (select * from customer where c_custkey % 10 <> 0) on c_custkey = o_custkey group by 1""")
def overview_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = load(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    s = F.col("o_orderstatus")
    n = lambda v: F.count(F.when(s == v, 1))
    return load(spark, sf_dir, "orders").join(agents, "o_custkey", "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("agent")).agg(
        F.count(F.lit(1)).alias("items"), n("O").alias("open"), n("P").alias("working"), n("F").alias("committed"), F.min(F.when(s == "O", F.col("o_orderkey"))).alias("next_item"))


@query("select o_orderkey, o_custkey, cast(row_number() over (order by o_orderdate, o_orderkey) as bigint) as place from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT' order by o_orderdate, o_orderkey limit 200")
def commit_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 next to commit, the number being the feature."""
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(200)
    return rows.select("o_orderkey", "o_custkey", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query(f"with {_QLOG}, {_TABLE} select event_id, item, from_status, op, to_status from q where not exists (select 1 from t where f = from_status and o = op and g = to_status)")
def queue_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.illegal(queue_log(spark, sf_dir)).select("event_id", "item", "from_status", "op", "to_status")


@query(f"with {_QLOG}, p as (select *, coalesce(lag(to_status) over (partition by item order by event_id), '-') as previous from q) select event_id, item, from_status, previous from p where previous <> from_status")
def queue_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.discontinuities(queue_log(spark, sf_dir), "item", "event_id").select("event_id", "item", "from_status", "previous")


@query(f"with {_QLOG} select item, arg_max(to_status, event_id) as status, cast(count(*) filter (op = 'claim') as bigint) as attempts, cast(count(*) as bigint) as n_events from q group by item")
def queue_replay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.replayed(queue_log(spark, sf_dir), "item", "event_id")


_ITEMS = f"{_QLOG}, i as (select item, arg_max(to_status, event_id) as status, max(ts) as leased_at, cast(count(*) filter (op = 'claim') % 4 as bigint) as attempt from q group by item)"


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_log(spark, sf_dir).groupBy("item").agg(F.max_by("to_status", "event_id").alias("status"), F.max("ts").alias("leased_at"), (F.count(F.when(F.col("op") == "claim", 1)) % 4).alias("attempt"))


@query(f"with {_ITEMS} select item, status as was, attempt + 1 as attempt, case when attempt + 1 > 3 then 'dead' else 'queued' end as status from i where status in ('claimed', 'running') and leased_at + interval 900 seconds < timestamp '2024-01-30 20:00:00'")
def expire_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.expired(queue_items(spark, sf_dir), "2024-01-30 20:00:00")


@query("""with i as (select o_orderkey as item, case o_orderstatus when 'P' then 'blocked' when 'F' then 'committed' else case when o_orderkey % 2 = 0 then 'cancelled' else 'queued' end end as status from orders),
 b as (select o_orderkey as item, o_custkey as blocker from orders) select item, 'queued' as status from i where status = 'blocked' and not exists (select 1 from b left join i j on j.item = b.blocker where b.item = i.item and coalesce(j.status, '') not in ('committed', 'cancelled'))""")
def unblock_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    items = o.selectExpr("o_orderkey as item", "case o_orderstatus when 'P' then 'blocked' when 'F' then 'committed' else case when o_orderkey % 2 = 0 then 'cancelled' else 'queued' end end as status")
    return workqueue.unblocked(items, o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("blocker")))


@query("select cast(ts as date) as day, event_type, cast(count(*) as bigint) as n from events where event_type <> 'view' group by 1, 2")
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type <> 'view'").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_CALLS = """c as (select event_id, user_id as claim, case when event_type = 'error' then null else event_type end as stage, ts as called_at, case when event_id % 3 = 0 then 'deepseek-v4-pro' else 'deepseek-v4-flash' end as model,
 cast(floor(value * 100) as bigint) as hit, cast(floor(value * 40) as bigint) as miss, cast(floor(value * 10) as bigint) as output from events),
p as (select *, (hour(called_at) >= 1 and hour(called_at) < 4) or (hour(called_at) >= 6 and hour(called_at) < 10) as is_peak from c),
u as (select *, (hit / 1e6 * case when model = 'deepseek-v4-pro' then 0.022 else 0.007 end + miss / 1e6 * case when model = 'deepseek-v4-pro' then 0.66 else 0.22 end + output / 1e6 * case when model = 'deepseek-v4-pro' then 1.98 else 0.66 end) * case when is_peak then 2 else 1 end as usd from p)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "events").selectExpr("event_id", "user_id as claim", "case when event_type = 'error' then null else event_type end as stage", "ts as called_at", "case when event_id % 3 = 0 then 'deepseek-v4-pro' else 'deepseek-v4-flash' end as model",
        "cast(floor(value * 100) as bigint) as hit", "cast(floor(value * 40) as bigint) as miss", "cast(floor(value * 10) as bigint) as output")
    return ledger.priced(c)


@query(f"with {_CALLS} select coalesce(stage, '(none)') as stage, cast(count(*) as bigint) as calls, cast(sum(hit + miss + output) as bigint) as tokens, round(sum(usd), 6) as usd from u group by 1")
def cost_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.by_stage(calls(spark, sf_dir))


@query(f"with {_CALLS} select is_peak, cast(count(*) as bigint) as calls, round(sum(usd), 6) as usd from u group by 1")
def cost_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("is_peak").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("usd"), 6).alias("usd"))


@query(f"""with {_CALLS}, s as (select c_custkey as claim, c_mktsegment as status from customer where c_custkey % 4 <> 0)
 select coalesce(status, '(none)') as status, cast(count(distinct u.claim) as bigint) as claims, round(sum(usd), 6) as usd, round(sum(usd) / count(distinct u.claim), 6) as usd_per_claim from u left join s on s.claim = u.claim group by 1""")
def cost_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = load(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("claim"), F.col("c_mktsegment").alias("status"))
    return ledger.by_outcome(calls(spark, sf_dir), statuses)


@query("select doc_id, cast(ceil(w + (length(text) - w) / 4) as bigint) as tokens from (select doc_id, text, length(text) - length(regexp_replace(text, '[\\x{3000}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]', '', 'g')) as w from documents)")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", ledger.estimate_tokens(F.col("text")).alias("tokens"))


_PROFILE = "select source as domain, cast(1 as bigint) as seen_count, case doc_id % 6 when 0 then 'T6_other' when 1 then 'T5_press' when 2 then 'T4_industry_data' when 3 then 'T3_working_paper' when 4 then 'T5_press' else case when n_chars > 9000 then 'T1_official' else 'T6_other' end end as tier, doc_id % 53 = 0 as blocked, case when doc_id % 3 = 0 then lang end as publisher, doc_id from documents"


@query(f"with p as ({_PROFILE}) select domain, cast(sum(seen_count) as bigint) as seen_count, min(tier) as tier, bool_or(blocked) as blocked, coalesce(min(publisher), domain) as publisher from p group by domain")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    rows = spark.sql(_PROFILE)
    return ledger.upsert(rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id"))


@query(f"with p as ({_PROFILE}) select domain, doc_id, was, tier from (select *, lag(tier) over (partition by domain order by doc_id) as was from p) where was <> tier and not blocked")
def registry_tier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return ledger.tier_changes(spark.sql(_PROFILE).withColumn("noted", F.col("blocked")), "doc_id").select("domain", "doc_id", "was", "tier")


@query("""with p as (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as domain, case when page_id % 19 = 0 then 'T1_official' else 'T5_press' end as tier from pages), f as (select unnest(['example', 'net', 'pills store', 'spam at www.example.com', 'tion']) as facet)
 select facet, cast(count(*) as bigint) as matches, min(page_id) as first_page from f, p where tier = 'T1_official' or (domain <> '' and contains(facet, domain))
  or len(list_intersect(list_filter(string_split(domain, '.'), lambda x: x <> '' and x not in ('com', 'org', 'net', 'gov', 'edu', 'io', 'co', 'uk', 'us', 'int', 'ac')), regexp_extract_all(facet, '[a-z0-9]+'))) > 0 group by facet""")
def facet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), F.when(F.col("page_id") % 19 == 0, "T1_official").otherwise("T5_press").alias("tier"))
    facets = F.explode(F.array(*map(F.lit, ("example", "net", "pills store", "spam at www.example.com", "tion"))))  # a constant list
    rows = profiles.withColumn("facet", facets)
    return rows.where(ledger.matches_facet(F.col("domain"), F.lit(""), F.col("tier"), F.col("facet"))).groupBy("facet").agg(F.count(F.lit(1)).alias("matches"), F.min("page_id").alias("first_page"))


_BIND = """t as (select c_custkey as target from customer), b as (select o_custkey as target, l_partkey as doc, case l_returnflag when 'A' then 'supports' when 'R' then 'refutes' end as direction from orders join lineitem on l_orderkey = o_orderkey),
d as (select p_partkey as doc, case when p_size % 7 = 0 then '' else p_brand end as publisher, case p_type when 'ECONOMY' then 'T1_official' when 'STANDARD' then 'T3_working_paper' when 'PROMO' then 'T5_press' else 'T4_industry_data' end as tier from part)"""


@query(f"""with {_BIND}, o as (select b.target, b.doc, coalesce(direction, 'context') as direction, publisher, tier from b left join d on d.doc = b.doc)
 select t.target as target, cast(count(o.doc) as bigint) as bindings, cast(count(*) filter (direction = 'supports') as bigint) as supports, cast(count(*) filter (direction = 'refutes') as bigint) as refutes, cast(count(*) filter (direction = 'context') as bigint) as context,
 cast(count(distinct o.doc) as bigint) as docs, cast(count(distinct publisher) as bigint) as distinct_publishers, coalesce(array_to_string(list_sort(list_distinct(list(tier) filter (tier is not null))), ','), '') as tiers,
 (count(*) filter (tier in ('T1_official', 'T2_peer_reviewed')) > 0 and count(distinct o.doc) >= 2) or (count(distinct o.doc) filter (tier in ('T3_working_paper', 'T4_industry_data')) >= 2 and count(distinct publisher) filter (tier in ('T3_working_paper', 'T4_industry_data') and publisher <> '') >= 2) as triangulated
 from t left join o on o.target = t.target group by t.target""")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are customers, bindings their orders' lines, documents the parts."""
    o, li, p = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    bindings = o.join(li, o["o_orderkey"] == li["l_orderkey"]).selectExpr("o_custkey as target", "l_partkey as doc", "case l_returnflag when 'A' then 'supports' when 'R' then 'refutes' end as direction")
    docs = p.selectExpr("p_partkey as doc", "case when p_size % 7 = 0 then '' else p_brand end as publisher", "case p_type when 'ECONOMY' then 'T1_official' when 'STANDARD' then 'T3_working_paper' when 'PROMO' then 'T5_press' else 'T4_industry_data' end as tier")
    return ledger.coverage(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")), bindings, docs)


_ANGLE = "select user_id as target, case event_id % 4 when 0 then 'official_stats' when 1 then 'academic' when 2 then 'counter' else 'industry' end as angle, case event_type when 'error' then 'tried_blocked' when 'purchase' then 'productive' when 'view' then 'no_attempt' else 'tried_empty' end as outcome from events"


@query(f"with a as ({_ANGLE}) select target, angle, case max(case outcome when 'productive' then 3 when 'tried_blocked' then 2 when 'tried_empty' then 1 else 0 end) when 3 then 'productive' when 2 then 'tried_blocked' when 1 then 'tried_empty' else 'no_attempt' end as outcome from a group by target, angle")
def angle_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return ledger.best_angle(spark.sql(_ANGLE), ["target", "angle"])


@query("""with r as (select o_custkey as target, o_orderkey as dr, case when o_orderstatus = 'F' then 1 else 0 end as closed, case when o_orderpriority = '5-LOW' then 0 else o_orderkey % 3 end as new_docs from orders)
 select target, cast(sum(closed) as bigint) as rounds, arg_max(new_docs, dr) as new_docs_last from r where closed = 1 group by target""")
def rounds_and_new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as target", "o_orderkey as dr", "case when o_orderpriority = '5-LOW' then 0 else o_orderkey % 3 end as new_docs")
    return r.groupBy("target").agg(F.count(F.lit(1)).alias("rounds"), F.max_by("new_docs", "dr").alias("new_docs_last"))


@query("""with r as (select *, case when event_type = 'purchase' then 1 else 0 end as p from events), i as (select *, sum(p) over (partition by user_id order by event_id) as island from r), s as (select *, sum(1 - p) over (partition by user_id, island order by event_id) as run from i)
 select user_id, cast(max(run) as bigint) as longest, min(event_id) filter (run >= 2) as stopped_at from s group by user_id""")
def no_progress_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.streak(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase")


@query("""with t as (select cast(c_custkey as varchar) as thread from customer), b as (select thread, (row_number() over (order by thread) - 1) // 6 as batch from t) select thread, batch from b""")
def orchestrator_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All threads in the order of their names, six at a time."""
    t = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("thread"))
    return current.numbered(t, "thread").select("thread", F.expr("(place - 1) div 6").alias("batch"))


@query("""with r as (select user_id as thread, event_id, row_number() over (partition by user_id order by event_id) as round, case event_type when 'purchase' then 'verified' when 'error' then 'contested' else 'open' end as outcome from events),
 a as (select *, max(case when outcome in ('verified', 'contested') then 1 else 0 end) over (partition by thread order by event_id rows between unbounded preceding and 1 preceding) as done from r where round <= 5)
 select thread, cast(count(*) as bigint) as rounds, case when bool_or(outcome <> 'open') then arg_max(outcome, event_id) else 'not_covered' end as status from a where coalesce(done, 0) = 0 group by thread""")
def orchestrator_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("thread").orderBy("event_id")
    r = load(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "event_id", F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "error", "contested").otherwise("open").alias("outcome"))
    a = r.withColumn("round", F.row_number().over(w)).where("round <= 5").withColumn("done", F.max((F.col("outcome") != "open").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return a.where("coalesce(done, 0) = 0").groupBy("thread").agg(F.count(F.lit(1)).alias("rounds"), F.when(F.bool_or(F.col("outcome") != "open"), F.max_by("outcome", "event_id")).otherwise("not_covered").alias("status"))


@query("select time_bucket(interval 6 hours, ts) as start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""with g as (select *, case when ts >= lag(ts) over w + interval 8 hours or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g)
 select user_id, min(ts) as start, cast(count(*) as bigint) as n from s group by user_id, sid""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "8 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")

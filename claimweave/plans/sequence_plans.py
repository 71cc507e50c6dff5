"""Queries about what holds as of a time, bound to conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import explore, topics
from claimweave.operators.asof import as_of
from claimweave.plans.registry import query
from claimweave.sources.tables import load

STOP = ["and", "the", "for"]
_CORE = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ('and', 'the', 'for')))"
_CLAIMS = f"""c as (select conv_id, turn, a, lag(a) over (partition by conv_id order by turn) as b from (select conv_id, turn, {_CORE.format("text")} as a from conversations where role = 'user')),
 x as (select conv_id, turn from c where b is not null and len(b) > 0 and (len(a) + len(b) - 2 * len(list_intersect(a, b))) * 2 > len(a) + len(b)), q as (select conv_id, turn from conversations where role <> 'user')"""


def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, since): where what is asked has drifted by more than half of its core terms from what was asked before."""
    c = load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.core_terms(F.col("text"), STOP).alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where((F.size("b") > 0) & text.far_apart(F.col("b"), F.col("a"))).select("conv_id", "turn", F.col("turn").alias("since"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role <> 'user'").select("conv_id", "turn")


@query(f"with {_CLAIMS} select q.conv_id as conv_id, q.turn as turn, x.turn as since from q asof left join x on x.conv_id = q.conv_id and q.turn >= x.turn")
def request_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow that holds when a search is asked for: none, or the last one before."""
    return as_of(requests(spark, sf_dir), narrowed(spark, sf_dir), "conv_id", "turn", "since")


@query(f"with {_CLAIMS}, l as (select conv_id, max(turn) as last from x group by conv_id) select q.conv_id as conv_id, count(*) as asked, count(*) filter (l.last is null or q.turn >= l.last) as rounds from q left join l on l.conv_id = q.conv_id group by q.conv_id")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of search that count: those from the latest narrow on, as what was found for another claim saturates nothing."""
    own = as_of(requests(spark, sf_dir), narrowed(spark, sf_dir), "conv_id", "turn", "since")
    last = narrowed(spark, sf_dir).groupBy("conv_id").agg(F.max("since").alias("last"))
    counts = own.join(last, "conv_id", "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("since").eqNullSafe(F.col("last")), 1)).alias("rounds"))
    return counts


_OUTCOME = "case event_type when 'purchase' then 'verified' when 'error' then 'contested' when 'click' then 'unverified' else 'attributed' end"
TERMINAL = ("verified", "contested")


# the rounds of all threads one after another: k numbers the calls of a round by thread
@query(f"""with recursive o as materialized (select cast(user_id as varchar) as thread, {_OUTCOME} as status, row_number() over (partition by user_id order by event_id) as round from events), b as (select count(*) // 40 as budget from events),
 r as (select distinct thread, cast(0 as bigint) as round, cast(null as varchar) as status, 0 as stale, false as done, budget as left_over, false as out from o, b
  union all select thread, round, case when paid then status else 'not_covered' end, stale, not paid or status in ('verified', 'contested') or stale >= 2, left_over, not paid
  from (select r.thread, r.round + 1 as round, o.status as status, case when o.status = r.status then r.stale + 1 else 0 end as stale, row_number() over (order by r.thread) <= r.left_over as paid, greatest(r.left_over - count(*) over (), 0) as left_over
   from r join o on o.thread = r.thread and o.round = r.round + 1 where not r.done and r.round < 5))
 select thread, cast(max(round) as int) as rounds, arg_max(status, round) as status, bool_or(out) as exhausted from r where round > 0 group by thread""")
def budget_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads (users) explored in rounds under one budget of calls: how far each comes, and which end without being covered."""
    e = load(spark, sf_dir, "events")
    o = e.select(F.col("user_id").cast("string").alias("thread"), F.col("event_id").alias("seq"), F.expr(_OUTCOME).alias("status"))
    return explore.explored(o, TERMINAL, e.count() // 40)


_HEADS = "array({names}, 'Notes', 'topic ')".format(names=", ".join(f"'{s.title()}'" for s in topics.SECTIONS))
_LINE = "case when k % 5 = 0 then '## ' || {heads}[(doc_id + k // 5) % 11 + 1] when k % 5 = 1 then ' - ' || line when k % 5 = 2 then (k + 1) || '. ' || line else line end"
_FILE = f"""l as (select doc_id, k - 1 as k, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null)),
 f as (select doc_id, k, {_LINE.format(heads=_HEADS.replace("array(", "[").replace("'topic ')", "'topic ']"))} as line from l), h as (select *, case when regexp_matches(line, '^#{{1,6}}\\s+') then lower(trim(regexp_replace(line, '^#+\\s+', ''))) end as title from f),
 s as (select doc_id, k, line, title, sum(case when title is not null then 1 else 0 end) over (partition by doc_id order by k) as b from h), n as (select doc_id, b, max(title) as section from s where b > 0 group by doc_id, b having max(title) in ({", ".join(f"'{x}'" for x in topics.SECTIONS)})),
 first as (select doc_id, section, min(b) as b, count(*) as times from n group by doc_id, section)"""
_MARK = "'^\\s*([-*]|\\d+[.)])\\s+'"


@query(f"""with {_FILE}, w as (select first.doc_id, section, times, k, line, regexp_matches(line, {_MARK}) as item, trim(line, chr(32) || chr(9) || chr(13)) <> '' as has from first left join s on s.doc_id = first.doc_id and s.b = first.b and s.title is null)
 select doc_id, section, cast(case when count(*) filter (item) > 0 then count(*) filter (item) when count(*) filter (has) > 0 then 1 else 0 end as int) as items, cast(case when count(*) filter (item) > 0 then count(*) filter (not item and has) else 0 end as int) as stray, count(*) filter (has) = 0 as empty, any_value(times) > 1 as repeated,
  coalesce(string_agg(case when item then trim(regexp_replace(line, {_MARK}, '')) end, '|' order by k), regexp_replace(string_agg(line, chr(10) order by k), '^\\s+|\\s+$', '', 'g'), '') as listed from w group by doc_id, section""")
def topic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as topic files, a heading every fifth line, and read back: sections, their items, what is stray, empty or twice."""
    line = lambda x, k: (
        F.when(k % 5 == 0, F.concat(F.lit("## "), F.element_at(F.expr(_HEADS), ((F.col("doc_id") + F.floor(k / 5)) % 11 + 1).cast("int")))).when(k % 5 == 1, F.concat(F.lit(" - "), x)).when(k % 5 == 2, F.concat(k + 1, F.lit(". "), x)).otherwise(x)
    )
    files = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("file"))
    p = topics.parsed(files, "doc_id", "file")
    return p.select("doc_id", "section", F.size("items").alias("items"), "stray", "empty", "repeated", F.array_join("items", "|").alias("listed"))

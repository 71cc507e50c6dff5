"""Queries about how many sources are independent. Sources are the turns of all conversations, every seventh conversation's once more with a few words added; quotes are their whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import independence
from claimweave.operators.graph import written
from claimweave.plans.registry import query
from claimweave.sources.tables import load

#: What the turns stand for, in SQL that Spark and DuckDB both read (c: id, conv_id, turn, role, text).
FIELDS = """case when id % 12 = 2 then concat('10.1/', cast(length(text) % 100 as {string})) end as doi, case when id % 12 = 4 then concat('hep.', cast(length(text) % 50 as {string}), 'v', cast(turn as {string})) end as arxiv_id, case when id % 12 = 6 then concat('W', cast(length(text) % 60 as {string})) end as work_id,
 regexp_extract(text, '^[^.]*', 0) as title, {array}(concat('P. ', cast(conv_id % 40 as {string})), concat('Q. ', cast(length(text) % 30 as {string}))) as authors, case when id % 11 = 3 then id - 200 end as cites_source_id, case when length(text) % 97 = 0 then concat(role, ' wire') end as upstream_id, case when conv_id % 31 = 5 then concat('group ', cast(conv_id as {string})) end as self_cite_group"""
_WORDS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')))"
_CLEAN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NUMBERS = "regexp_extract_all({}, '\\d+(?:\\.\\d+)?')"
_STAR = "select {rule} as rule, id as a, min(id) over (partition by {key}) as b from k where {key} <> ''"
# all links, then those that join something, taken one by one in order: lab holds the label of every source so far
_LOG = f"""c as (select 200 * conv_id + 2 * turn as id, conv_id, turn, role, text from conversations union all select 200 * conv_id + 2 * turn + 1, conv_id, turn, role, text || ' so it is' from conversations where conv_id % 7 = 0),
 k0 as (select id, text, sha256(text) as sha, {FIELDS.format(string='varchar', array='list_value')} from c),
 k as materialized (select *, case when doi is not null then 'doi:' || {_CLEAN.format('doi')} when arxiv_id is not null then 'arxiv:' || regexp_replace({_CLEAN.format('arxiv_id')}, 'v\\d+$', '') when work_id is not null then 'work:' || {_CLEAN.format('work_id')} end as exact_key,
  case when {_CLEAN.format('title')} <> '' then 'ta:' || {_CLEAN.format('title')} || '|' || {_CLEAN.format('authors[1]')} end as ta_key, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as said from k0),
 s as materialized (select min(id) as id, array_to_string(list_sort({_NUMBERS.format('said')}), ',') as d, list_distinct(list_transform(range(1, length(said) - 3), lambda i: said[i : i + 4])) as g from k where length(said) >= 5 group by said),
 near as (select a.id as a, b.id as b, len(list_intersect(a.g, b.g)) as i, len(a.g) as n, len(b.g) as m from s a join s b on a.id < b.id and a.d = b.d and least(len(a.g), len(b.g)) >= 0.82 * greatest(len(a.g), len(b.g))),
 l as ({" union all ".join(_STAR.format(rule=rule, key=key) for rule, key in ((0, "sha"), (2, "exact_key"), (3, "ta_key"), (5, "upstream_id"), (6, "self_cite_group")))}
  union all select 1, id, min(id) over (partition by said) from k where length(said) >= 5 union all select 1, a, b from near where i / (n + m - i) >= 0.82 union all select 4, id, cites_source_id from k where cites_source_id in (select id from k)),
 e as materialized (select least(a, b) as a, greatest(a, b) as b, min(rule) as rule from l where a <> b group by 1, 2), ids as materialized (select id, row_number() over (order by id) as p from (select distinct id from k)),
 o as materialized (select row_number() over (order by rule, a, b) as n, rule, a, b, x.p as pa, y.p as pb from e join ids x on x.id = a join ids y on y.id = b),
 f as (select cast(0 as bigint) as n, (select list(p order by p) from ids) as lab, false as took union all select o.n, list_transform(lab, lambda x: case when x = greatest(lab[pa], lab[pb]) then least(lab[pa], lab[pb]) else x end), lab[pa] <> lab[pb] from f join o on o.n = f.n + 1),
 roots as materialized (select ids.id as id, r.id as root from (select unnest(lab) as q, generate_subscripts(lab, 1) as p from (select lab from f order by n desc limit 1)) z join ids on ids.p = z.p join ids r on r.p = z.q)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, id = load(spark, sf_dir, "conversations"), 200 * F.col("conv_id") + 2 * F.col("turn")
    both = c.select(id.alias("id"), "conv_id", "turn", "role", "text").union(c.where("conv_id % 7 = 0").select(id + 1, "conv_id", "turn", "role", F.concat("text", F.lit(" so it is"))))
    both.createOrReplaceTempView("turns_as_sources")
    return spark.sql(f"select id, sha2(text, 256) as object_sha256, text as anchor, {FIELDS.format(string='string', array='array')} from turns_as_sources")


@query(f"with recursive {_LOG} select id, root, count(*) over (partition by root) as members, (select count(distinct root) from roots) as n_clusters from roots")
def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its cluster by all rules, the cluster's members, and how many clusters there are."""
    refs = sources(spark, sf_dir)
    roots = written(independence.clusters(refs, independence.links(refs)))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    return roots.join(sizes, "root").crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("n_clusters")))).select("id", "root", "members", "n_clusters")


@query(f"""with recursive {_LOG} select o.a as source, o.b as target, ({[*independence.RULES]!r})[o.rule + 1] as rule, case when o.rule = {independence.NEAR_RULE} then 'near' else 'exact' end as level from f join o on o.n = f.n where f.took""")
def source_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merge with the first rule that makes it, and whether it is exact."""
    return independence.named(independence.forest(independence.links(sources(spark, sf_dir))))


@query(f"""with recursive {_LOG}, sets as (select 'similar-title' as rule, 0.8 as least, id, {_WORDS} as w from k union all select 'common-authors', 0.9, id, list_sort(list_distinct(list_transform(authors, lambda a: {_CLEAN.format('a')}))) from k),
 each as (select rule, least, w, min(id) as id from sets where len(w) > 0 group by all), u as (select rule, least, id, len(w) as n, unnest(w) as x from each), p as (select rule, x.id as a, y.id as b, any_value(x.n + y.n) as n, count(*) as c, any_value(x.least) as least from u x join u y using (rule, x) where x.id < y.id group by 1, 2, 3),
 nums as (select distinct id, unnest(list_filter({_NUMBERS.format('text')}, lambda n: length(regexp_replace(replace(n, '.', ''), '^0+', '')) >= 3 and not regexp_full_match(n, '(19|20)\\d\\d') and n not in ('100', '50', '95', '99'))) as x from k),
 every as (select a, b, rule from p where c >= least * (n - c) - 1e-9 union select min(id) over (partition by rule, w), id, rule from sets where len(w) > 0 union select min(id) over (partition by x), id, 'same-rare-number' from nums)
 select least(a, b) as a, greatest(a, b) as b, rule from every join roots x on x.id = a join roots y on y.id = b where x.root <> y.root""")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely identities between clusters that no rule proves: proposals only, each group through its least source."""
    refs = sources(spark, sf_dir)
    return independence.candidates(refs, written(independence.clusters(refs, independence.links(refs))))

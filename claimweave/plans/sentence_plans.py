"""Queries about sentences, numbers, periods and scopes, bound to documents, benchmark items and orders.

The gates over sentences are bound to orders: each order's figure stands in one of a list of sentences, and what a gate must say of each is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import intervals, retrieve, substrings
from claimweave.plans.registry import query
from claimweave.sources.tables import load

_NQ = "regexp_replace(regexp_replace(trim(regexp_replace(replace(translate({0}, '‘’“”–—', '''''\"\"--'), '…', '...'), '\\s+', ' ', 'g')), '([\\x{{4E00}}-\\x{{9FFF}}])\\s+', '\\1', 'g'), '\\s+([\\x{{4E00}}-\\x{{9FFF}}])', '\\1', 'g')"
_CUT = "replace(substr(text, 5, 30), ' ', '  ') || case when n_chars % 4 = 0 then '…' else '' end"


@query(f"select doc_id, {_NQ.format('q')} as quote, contains({_NQ.format('text')}, {_NQ.format('q')}) as faithful from (select doc_id, text, {_CUT} as q from documents)")
def quote_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each document with its blanks doubled, in every fourth with an ellipsis behind it: whether the document has it."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_CUT).alias("q"))
    return rows.select("doc_id", text.normalize_quote(F.col("q")).alias("quote"), text.quote_faithful(F.col("q"), F.col("text")).alias("faithful"))


@query("""with n as (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'))) as x from documents), c as (select distinct doc_id, text, needle from (select doc_id, text, unnest([x, left(x, -1), x[2:]]) as needle from n) where regexp_matches(needle, '\\d'))
 select doc_id, needle, regexp_matches(text, '(^|[^0-9.,])' || replace(needle, '.', '\\.') || '[.,]*([^0-9.,]|$)') as found from c""")
def number_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each document, whole and with the first or the last digit cut off: whether they stand there as numbers of their own."""
    x = F.col("x")
    n = load(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array_distinct(text.numbers(F.col("text")))).alias("x"))
    n = n.select("doc_id", "text", F.explode(F.array_distinct(F.array(x, F.expr("left(x, length(x) - 1)"), F.expr("substring(x, 2)")))).alias("needle")).where(F.col("needle").rlike(r"\d")).dropDuplicates(["doc_id", "text", "needle"])
    return n.select("doc_id", "needle", text.number_at_border(F.col("text"), F.col("needle")).alias("found"))


ONES, TENS = text_udf.ONES, text_udf.TENS


@query("select p_partkey, p_size || '% of ' || p_name || ', ' || (p_partkey % 100) || '-' || p_size || ' or ' || (p_partkey % 20) || ' units' as form from part")
def numeric_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written out in words and numbers in Chinese digits and full-width forms, brought to one form."""
    at = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    size, tail, few = F.col("p_size"), F.col("p_partkey") % 100, F.col("p_partkey") % 20
    words = F.when(size < 20, at(ONES, size)).otherwise(F.concat(at(TENS, F.floor(size / 10) - 2), F.when(size % 10 > 0, F.concat(F.lit("-"), at(ONES, size % 10))).otherwise("")))
    wide = F.translate(tail.cast("string"), "0123456789", "０１２３４５６７８９")
    chinese = F.when(few < 10, at(list(text_udf.CHINESE), few)).otherwise(F.concat(F.lit("十"), F.when(few > 10, at(list(text_udf.CHINESE), few - 10)).otherwise("")))
    t = F.concat(words, F.lit(" percent of "), "p_name", F.lit(", "), wide, F.lit("–"), size.cast("string"), F.lit(" or  "), chinese, F.lit(" units"))
    return load(spark, sf_dir, "part").select("p_partkey", text_udf.numeric(t).alias("form"))


#: Periods as people write them: a year, years with one dash or another, turned about, or in words.
_PERIOD = "case when {k} % 11 = 0 then null when {k} % 11 = 1 then 'the ' || {y} || 's' when {k} % 11 = 2 then ' ' || {y} || ' ' when {k} % 11 = 3 then ({y} + {n}) || ' ～ ' || {y} when {k} % 11 < 7 then {y} || '–' || ({y} + {n}) else {y} || '-' || ({y} + {n}) end"
DOC_PERIOD, ITEM_PERIOD = _PERIOD.format(k="doc_id", y="(1900 + n_chars % 120)", n="n_chars % 6"), _PERIOD.format(k="item_id", y="(1900 + (item_id * 7) % 120)", n="item_id % 25")
_YEARS = "case when regexp_full_match(translate({p}, '‐‑‒–—―−－～〜~', '-----------'), '\\s*\\d{{4}}\\s*(-\\s*\\d{{4}}\\s*)?') then list_transform(regexp_extract_all({p}, '\\d{{4}}'), lambda x: cast(x as int)) end"
_DP = f"d as (select doc_id, lang, source, period, {_YEARS.format(p='period')} as ys from (select doc_id, lang, source, {DOC_PERIOD} as period from documents))"
_IP = f"i as (select item_id, period, {_YEARS.format(p='period')} as ys from (select item_id, {ITEM_PERIOD} as period from benchmark))"


def doc_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(DOC_PERIOD).alias("period"))


def item_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.expr(ITEM_PERIOD).alias("period"))


@query(f"with {_DP} select doc_id, list_min(ys) as lo, list_max(ys) as hi from d where ys is not null")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that a document's period names, the smaller first."""
    return doc_periods(spark, sf_dir).withColumn("y", text.year_range(F.col("period"))).where("y is not null").select("doc_id", "y.lo", "y.hi")


@query(f"with {_DP}, {_IP} select item_id, doc_id, greatest(list_min(d.ys), list_min(i.ys)) as lo, least(list_max(d.ys), list_max(i.ys)) as hi from d join i on list_min(d.ys) <= list_max(i.ys) and list_min(i.ys) <= list_max(d.ys)")
def period_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents whose periods meet, and the years in which they do: a join of intervals by bins."""
    years = lambda df, key: df.withColumn("y", text.year_range(F.col("period"))).where("y is not null").select(key, "y.lo", "y.hi")
    p = intervals.overlapping(years(item_periods(spark, sf_dir), "item_id"), years(doc_periods(spark, sf_dir), "doc_id"), "lo", "hi", 4)
    return p.select("l.item_id", "r.doc_id", F.greatest("l.lo", "r.lo").alias("lo"), F.least("l.hi", "r.hi").alias("hi"))


_MEET = "case when d.ys is not null and i.ys is not null then list_min(d.ys) <= list_max(i.ys) and list_min(i.ys) <= list_max(d.ys) else contains(lower(d.period), lower(i.period)) or contains(lower(i.period), lower(d.period)) end"
_ITEM_SCOPE = "case when item_id % 3 > 0 then upper(substr('endefres', cast(1 + 2 * (item_id % 4) as int), 2)) end as region, case item_id % 4 when 0 then 'SRC1,src2' when 1 then 'src3' when 2 then '' else 'Src5,src4,src1' end as actors"


@query(f"""with {_DP}, i as (select i.*, {_ITEM_SCOPE} from ({_IP[6:-1]}) i) select item_id, doc_id, (d.period is null or i.period is null or {_MEET}) and (lang is null or region is null or lower(lang) = lower(region))
 and (source is null or actors = '' or list_contains(string_split(lower(actors), ','), lower(source))) as compatible from d join i on d.doc_id % 40 = i.item_id % 40""")
def scope_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the scope of an item and that of a document it is laid beside can both hold: period, region (the language) and actors (the source)."""
    i = item_periods(spark, sf_dir).withColumnRenamed("period", "p2").selectExpr("item_id", "p2", *_columns(_ITEM_SCOPE), "item_id % 40 as lane")
    d = doc_periods(spark, sf_dir).withColumn("lane", F.col("doc_id") % 40)
    some = F.filter(F.split("actors", ","), lambda x: x != "")
    own = text.scope_compatible(F.col("period"), F.col("p2"), F.col("lang"), F.col("region"), F.when(F.col("source").isNotNull(), F.array("source")), some)
    return d.join(i, "lane").select("item_id", "doc_id", own.alias("compatible"))


def _columns(listed: str) -> list[str]:
    head, tail = listed.split(" as region, ")
    return [head + " as region", tail]


_TOK = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"


@query(f"""with {_DP}, i as (select i.*, {_ITEM_SCOPE} from ({_IP[6:-1]}) i), a as (select item_id, unnest({_TOK}) as w from benchmark), b as (select doc_id, unnest({_TOK}) as w from documents), m as (select item_id, doc_id, count(*) as score from a join b using (w) group by all having count(*) >= 2)
 select item_id, doc_id, cast(score as bigint) as score, cast(r as int) as place from (select m.*, row_number() over (partition by m.item_id order by score desc, m.doc_id) as r from m join d on d.doc_id = m.doc_id join i on i.item_id = m.item_id
  where (d.period is null or i.period is null or {_MEET}) and (lang is null or region is null or lower(lang) = lower(region)) and (source is null or actors = '' or list_contains(string_split(lower(actors), ','), lower(source)))) where r <= 12""")
def scoped_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dozen documents that share most words with each item and whose scope can hold with the item's: period, region, actors."""
    i = item_periods(spark, sf_dir).selectExpr("item_id", "period", *_columns(_ITEM_SCOPE)).join(load(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("item_id", "claim").withColumn("years", text.year_range(F.col("period")))
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text", "lang", "source", F.expr(DOC_PERIOD).alias("period")).withColumn("years", text.year_range(F.col("period")))
    some = F.filter(F.split("actors", ","), lambda x: x != "")
    fits = text.scope_compatible(F.col("u_period"), F.col("period"), F.col("u_lang"), F.col("region"), F.when(F.col("u_source").isNotNull(), F.array("u_source")), some, F.col("u_years"), F.col("years"))
    return retrieve.best_matches(i, d, compatible=fits).select(F.col("claim").alias("item_id"), F.col("unit").alias("doc_id"), "score", "place")


_INNER = "substr(w, 2, length(w) - 2)"


@query(f"""with l as (select item_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) as w from benchmark), p as (select item_id, {_INNER} as quote from (select *, row_number() over (partition by item_id order by length(w) desc, w) as r from l) where r = 1 and length(w) > 2)
 select item_id, quote, count(doc_id) as docs, min(doc_id) as first from p left join documents on contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), quote) group by item_id, quote""".replace("\\\\", "\\"))
def quote_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold the inside of each item's longest word: quotes without a whole word, found by their rarest grams."""
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), 1)["w"]
    p = load(spark, sf_dir, "benchmark").select("item_id", longest.alias("w")).where("length(w) > 2").select("item_id", F.expr("substring(w, 2, length(w) - 2)").alias("quote"))
    bodies = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.squeeze(F.col("text")).alias("body"))
    return p.join(substrings.holding(p, bodies), "quote", "left").groupBy("item_id", "quote").agg(F.count("doc").alias("docs"), F.min("doc").alias("first"))


STARTS, WIDTH = (1, 9, 25, 60, 110), 12
_STOPS = "list_filter(range(1, len(c) + 1), lambda k: c[k] = '。' or (c[k] = '.' and not (regexp_matches(coalesce(c[k - 1], ''), '^[0-9]') and regexp_matches(coalesce(c[k + 1], ''), '^[0-9]'))))"


@query(f"""with t as (select item_id, text, string_split(text, '') as c from benchmark), s as (select item_id, text, {_STOPS} as stops from t), a as (select *, unnest({list(STARTS)}) as k from s),
 b as (select item_id, k, text, stops, instr(text, substr(text, k, {WIDTH})) as i, length(substr(text, k, {WIDTH})) as n from a where substr(text, k, {WIDTH}) <> ''), x as (select *, coalesce(list_max(list_filter(stops, lambda p: p < i)), 0) + 1 as f, case when list_contains(stops, i + n - 1) then i + n - 1 else coalesce(list_min(list_filter(stops, lambda p: p >= i + n)), length(text)) end as e from b)
 select item_id, cast(k as int) as k, regexp_replace(substr(text, f, e - f + 1), '^\\s+|\\s+$', '', 'g') as sentence from x""")
def containing_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sentence around a piece of an item. A dot between digits ends none, and a piece that ends with its stop brings no further sentence."""
    a = load(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, STARTS))).alias("k")).withColumn("anchor", F.expr(f"substring(text, k, {WIDTH})")).where("anchor <> ''")
    return a.select("item_id", "k", text.containing_sentence(F.col("text"), F.col("anchor")).alias("sentence"))


#: The cases of each gate: its arguments, a # for the order's figure, and what it must say.
GATES = {
    "polarity": (text_udf.polarity, [
        ("#%", "The method reached #% on the set.", "pass"), ("#%", "The method did not reach #% on the set.", "NEG-S"), ("#%", "It reached at most #% here.", "NEG-L,NEG-P"), ("gain", "Gain was comparable, gain was seen.", "NEG-N"), ("#%", "If tuned, it gains #% more.", "NEG-C,NEG-P"),
        ("#%", "在无噪声情况下达到#%。", "NEG-S,NEG-C"), ("#", "Gains did not reach significance at # sites.", "NEG-S,NEG-N"), ("19-9", "A test for 19-9 was used.", "pass"), ("#", "It topped # in trials.", "NEG-P"), ("#%", "They claimed a #% gain.", "NEG-R"), ("#", "It is not true that it never gave # hits.", "pass"),
        ("x", "no such", "absent"), ("#%", "准确率未达到#%。", "NEG-S"), ("#%", "Is it #%?", "NEG-I")]),
    "frame": (text_udf.frame, [("#.4", "", "It scored #.4 points in all.", "alone"), ("#%", "treated", "#% of treated and 12% of control patients", "told"), ("#%", "patients", "#% of treated patients and 12% of control patients", "ambiguous"), ("7", "a", "there were # of them", "absent"), ("#%", "", "#% or 12% of patients", "ambiguous")]),
    "containment": (text_udf.containment, [("value", "#", "a rate of #% was seen", "exact"), ("value", "36%", "thirty-six percent of #", "numeric"), ("value", "3", "a rate of 3#% was seen", None), ("entity", "network models", "the networks model worked #", "stem"), ("entity", "training runs", "trained on # training run", None), ("metric", "thirty", "# of them", None)]),
    "counter_scan": (text_udf.counter_scan, [
        ("AlphaFold", "alphafold not replication", "W2", "W#", "W1,W2", "pass"), ("AlphaFold", "other not", "W2", "W#", "W1,W2", "a"), ("AlphaFold", "alphafold not weather", "W2", "W#", "W1,W2", "b"), ("AlphaFold", "alphafold not failed", "W2", "W#", "W1,W2", "pass"), ("AlphaFold", "alphafold not the failed", "W2", "W#", "W1,W2", "c"),
        ("AlphaFold", "alphafold replicated", "W2", "W#", "W1,W2", "c"), ("AlphaFold", "alphafold below #", "W2", "W1", "W1,W2", "pass"), ("AlphaFold", "alphafold disputed", "W2", "W#", "W1,W2", "pass"), ("AlphaFold", "alphafold disputed retracted refuted", "W2", "W#", "W1,W2", "c"), ("AlphaFold", "alphafold not", "W#", "W#", "W1,W#", "d"),
        ("AlphaFold", "alphafold not", "W9", "W#", "W1,W2", "e"), ("AlphaFold", "alphafold not", "", "W1", "W#", "pass")]),
    "bare_number_gate": (lambda t: ",".join(text_udf.bare_numbers(t)), [("Gain of {{c1.value}} was seen.", ""), ("Gain of #% was seen.", "#"), ("In Table #, (2019) work: {{c1.value}}", ""), ("COVID-# and GPT4 aside", ""), ("百分之五 {{c2.value}}", "百分之五"), ("2.#e3 units", "2.#e3")]),
}
FIGURE = "cast(20 + cast(floor(o_totalprice) as bigint) % 70 as {})"


def _quoted(v: str | None) -> str:
    return "cast(null as varchar)" if v is None else "'" + v.replace("'", "''") + "'"


def _gate_sql(cases: list[tuple]) -> str:
    pick = lambda at: "case k " + " ".join(f"when {i} then {_quoted(c[at])}" for i, c in enumerate(cases)) + " end"
    return f"select id, replace({pick(0)}, '#', n) as asked, replace({pick(-1)}, '#', n) as verdict from (select o_orderkey as id, o_orderkey % {len(cases)} as k, {FIGURE.format('varchar')} as n from orders)"


for _name, (_f, _cases) in GATES.items():

    def _gate(spark: SparkSession, sf_dir: str, f: object = _f, cases: list[tuple] = _cases) -> DataFrame:
        o = load(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"cast(o_orderkey % {len(cases)} + 1 as int) as k", f"{FIGURE.format('string')} as n")
        arg = lambda at: F.replace(F.element_at(F.array(*[F.lit(c[at]) for c in cases]), F.col("k")), F.lit("#"), F.col("n"))
        return o.select("id", arg(0).alias("asked"), text_udf.rowwise(f, *[arg(at) for at in range(len(cases[0]) - 1)]).alias("verdict"))

    query(_gate_sql(_cases), name=_name)(_gate)

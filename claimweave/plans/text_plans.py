"""Queries about text functions and retrieval, bound to documents, benchmark items, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import retrieve, vectors
from claimweave.operators.graph import cut
from claimweave.operators.sizes import small
from claimweave.operators.status import with_status
from claimweave.plans.registry import query
from claimweave.sources.tables import load

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


@query(f"select doc_id, cast(len({_TOK}) as bigint) as n, sha256(array_to_string({_TOK}, ' ')) as h from documents")
def tokens_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


@query("select doc_id, cast(len(t) as bigint) as n, sha256(array_to_string(list_sort(t), ' ')) as h from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents)")
def tokens_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.ascii_tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("h"))


@query(f"select lang, cast(sum(len({_TOK})) as bigint) as words, cast(max(len({_TOK})) as bigint) as longest from documents group by lang")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.tokens(F.col("text")))
    return docs(spark, sf_dir).groupBy("lang").agg(F.sum(n).alias("words"), F.max(n).cast("long").alias("longest"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"select doc_id, cast(len(s) as bigint) as n, sha256(array_to_string(s, '|')) as h from (select doc_id, {_SENT} as s from documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("h"))


_STEM = "case when ends_with(w, 'ions') and length(w) >= 8 then w[:-5] when ends_with(w, 'ion') and length(w) >= 7 then w[:-4] when ends_with(w, 'ing') and length(w) >= 7 then w[:-4] when ends_with(w, 'ies') and length(w) >= 7 then w[:-4] when ends_with(w, 'es') and length(w) >= 6 then w[:-3] when ends_with(w, 'ed') and length(w) >= 6 then w[:-3] when ends_with(w, 's') and length(w) >= 5 then w[:-2] when ends_with(w, 'e') and length(w) >= 5 then w[:-2] else w end"


@query(f"with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark) select w as word, {_STEM} as stem from t")
def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


_NUM = "regexp_extract_all(text, '\\d+(?:\\.\\d+)?')"


@query(f"select doc_id, array_to_string(list_sort({_NUM}), ',') as signature from documents")
def digit_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.digit_signature(F.col("text")).alias("signature"))


@query(f"""select doc_id, array_to_string(list_sort(list_distinct(list_filter({_NUM}, lambda n: length(regexp_replace(replace(n, '.', ''), '^0+', '')) >= 3 and not regexp_full_match(n, '(19|20)\\d\\d') and n not in ('100', '50', '95', '99')))), ',') as rare from documents""")
def rare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.rare_numbers(F.col("text")), ",").alias("rare"))


@query("""with s as (select item_id, text, list_distinct(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i : i + 4])) as g from benchmark)
 select a.item_id as a, b.item_id as b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) as jaccard from s a join s b on b.item_id = a.item_id + 1""")
def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "benchmark").select("item_id", text.shingles(F.col("text")).alias("g"))
    b = s.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("g").alias("h"))
    return s.join(b, "item_id").select(F.col("item_id").alias("a"), "b", F.round(text.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query("""with p as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as t from pages)
 select page_id, cast(length(t) as bigint) as n, sha256(t) as h from p""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.strip_tags(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("h"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\\.', '') as domain from pages")
def source_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


_CANON = """with p as (select page_id, lower(regexp_extract(url, '^(\\w+)://', 1)) as s, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') as h, regexp_replace(regexp_replace(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '(.)/$', '\\1') as p,
 array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)')), '&') as q from pages)
 select page_id, s || '://' || h || p || case when q = '' then '' else '?' || q end as url from p"""


@query(_CANON)
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query(_CANON)
def canonical_url_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text_udf.canonical_url("url").alias("url"))


@query("""with b as (select page_id, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) as t, generate_subscripts(regexp_extract_all(html, '<p>([^<]*)</p>', 1), 1) as k from pages)
 select page_id, 'p' || k as locator, cast(length(t) as bigint) as n, sha256(t) as h from b""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of a page that hold no other element, by their place."""
    return passage_rows(spark, sf_dir).select("page_id", F.concat(F.lit("p"), F.col("ord")).alias("locator"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h"))


def passage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<p>([^<]*)</p>"), F.lit(1))).alias("k", "text")).withColumn("ord", F.col("k") + 1)


@query(f"""with b as (select page_id, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) as t, generate_subscripts(regexp_extract_all(html, '<p>([^<]*)</p>', 1), 1) as ord from pages),
 w as (select *, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}%.$]+'), lambda w: length(w) > 1 and w not in ({", ".join("'" + x + "'" for x in text.STOP)})), lambda w: {_STEM})) as g, ord // 5 as sec from b),
 s as (select *, len(list_intersect(g, ['thes', 'ther', 'from', 'rely', 'onnd'])) as o, len(list_intersect(g, ['thes', 'ther', 'from', 'rely', 'onnd'])) / 5 + case when regexp_matches(t, '\\d') then 0.15 else 0 end as score from w),
 d as (select *, count(*) filter (score >= 0.15) over (partition by page_id) as n from s), k as (select *, case when n >= 3 then score >= 0.15 else o > 0 or regexp_matches(t, '\\d') end as good from d),
 r as (select *, row_number() over (partition by page_id order by good desc, score desc, ord) as r from k), e as (select *, good and r <= 12 as kept from r)
 select page_id as doc, cast(ord as int) as ord, round(score, 6) as score, kept or (regexp_matches(t, '\\d') and max(case when kept then 1 else 0 end) over (partition by page_id, sec) = 1) as kept from e""")
def passage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_rows(spark, sf_dir).select(F.col("page_id").alias("doc"), F.col("ord").cast("int").alias("ord"), F.expr("ord div 5").alias("sec"), F.lit(None).cast("string").alias("title"), "text")
    return retrieve.select_passages(rows, ["thes", "ther", "from", "rely", "onnd"]).select("doc", "ord", F.round("score", 6).alias("score"), "kept")


_STOPS = ["and", "the", "for"]


@query("""with t as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ('and', 'the', 'for'))) as a from benchmark)
 select x.item_id as item_id, cast(len(x.a) as bigint) as n, (len(x.a) + len(y.a) - 2 * len(list_intersect(x.a, y.a))) * 2 > len(x.a) + len(y.a) as reset from t x join t y on y.item_id = x.item_id + 1""")
def core_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "benchmark").select("item_id", text.core_terms(F.col("text"), _STOPS).alias("a"))
    return t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id").select("item_id", F.size("a").cast("long").alias("n"), text.far_apart(F.col("a"), F.col("b")).alias("reset"))


@query("""select item_id, cast(count(*) as bigint) as n from (select item_id, w, count(*) as f, min(i) as first, row_number() over (partition by item_id order by count(*) desc, min(i)) as r from (select item_id, unnest(t) as w, generate_subscripts(t, 1) as i from (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from benchmark)) group by item_id, w) where r <= 6 and length(w) > 2 group by item_id""")
def ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_terms(spark, sf_dir).where(F.length("w") > 2).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.tokens(F.col("text"))).alias("i", "w")).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("f"), F.min("i").alias("first"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("f"), "first"))).where("r <= 6")


_PLAN = """with t as (select item_id, w, row_number() over (partition by item_id order by count(*) desc, min(i)) as r from (select item_id, unnest(t) as w, generate_subscripts(t, 1) as i from (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from benchmark)) group by item_id, w),
 c as (select item_id, string_agg(w, ' ' order by r) as core from t where r <= 6 group by item_id), n as (select item_id, string_agg(w, ' ' order by r) as narrow from t where r <= 3 group by item_id),
 a as (select c.item_id as item_id, unnest([core, core || ' official statistics', narrow, core || ' decline criticism']) as q, unnest(['core', 'angle', 'narrow', 'counter']) as kind, unnest([1, 2, 3, 4]) as k from c join n on n.item_id = c.item_id)"""


@query(_PLAN + " select item_id, kind, q from (select *, row_number() over (partition by item_id, q order by k) as d from a) where d = 1")
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core, angle, narrow and counter queries of each item, equal ones once."""
    listed = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= n, F.struct("r", "w")))), lambda x: x["w"]), " ")
    own = top_terms(spark, sf_dir).groupBy("item_id").agg(listed(6).alias("core"), listed(3).alias("narrow"))
    kinds = [("core", F.col("core")), ("angle", F.concat("core", F.lit(" official statistics"))), ("narrow", F.col("narrow")), ("counter", F.concat("core", F.lit(" decline criticism")))]
    every = own.select("item_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("q")) for k, q in kinds])).alias("k", "x"))
    return every.groupBy("item_id", F.col("x.q").alias("q")).agg(F.min_by("x.kind", "k").alias("kind"))


@query("select sha256(text) as content_hash, min(doc_id) as first_doc, cast(count(*) as bigint) as n, array_to_string(list_sort(list_distinct(list(source))), ',') as sources from documents group by 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.merge_by_content(docs(spark, sf_dir))


@query("""with m as (select doc_id, sha256(text) as h, first_value(doc_id) over (partition by text order by doc_id) as rep, row_number() over (partition by text order by doc_id) as k from documents)
 select doc_id, rep, case when k = 1 then 'kept' else 'merged' end as fate, case when k > 1 then '#' || k else '' end as mark from m""")
def wave_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's representative (the first seen of its content) and the mark of its occurrence."""
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    k = F.row_number().over(w)
    return docs(spark, sf_dir).select("doc_id", F.first("doc_id").over(w).alias("rep"), k.alias("k")).select("doc_id", "rep", F.when(F.col("k") == 1, "kept").otherwise("merged").alias("fate"), F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k"))).otherwise("").alias("mark"))


_FP = "sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || chr(10) || array_to_string(list_sort([lower(role), 'turn ' || turn]), chr(10)))"


@query(f"with f as (select conv_id, turn, {_FP} as fp from conversations) select conv_id, turn, fp, conv_id = min(conv_id) over (partition by fp) and turn = min(turn) over (partition by fp) as fresh from f")
def fingerprint_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.array(F.col("role"), F.concat(F.lit("turn "), F.col("turn")))
    f = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.request_fingerprint(F.col("text"), hints).alias("fp"))
    w = Window.partitionBy("fp")
    return f.select("conv_id", "turn", "fp", ((F.col("conv_id") == F.min("conv_id").over(w)) & (F.col("turn") == F.min("turn").over(w))).alias("fresh"))


_KW = f"""with a as (select item_id, unnest(list_distinct({_TOK})) as w from benchmark), b as (select doc_id, unnest(list_distinct({_TOK})) as w from documents), m as (select item_id, doc_id, count(*) as score from a join b using (w) group by all having count(*) >= 2)"""


@query(_KW + " select item_id, cast(count(*) as bigint) as units, cast(max(score) as bigint) as best from m group by item_id")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retrieve.keyword_match(load(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("units"), F.max("score").alias("best"))


@query(_KW + " select item_id, doc_id, cast(score as bigint) as score, cast(r as int) as place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from m) where r <= 12")
def pack_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, units = load(spark, sf_dir, "benchmark").selectExpr("item_id as claim", "text"), docs(spark, sf_dir).selectExpr("doc_id as unit", "text")
    return retrieve.best_matches(items, units).select(F.col("claim").alias("item_id"), F.col("unit").alias("doc_id"), "score", "place")


_VEC = "with q as (select vec_id as q, cast(embedding as double[]) as a, label as ql from embeddings where vec_id % 50 = 0), v as (select vec_id as v, cast(embedding as double[]) as b, label as vl from embeddings)"


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The queries (every fiftieth vector) and all vectors."""
    e = load(spark, sf_dir, "embeddings").where("embedding is not null")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"), F.col("label").alias("ql"))
    return q, e.select(F.col("vec_id").alias("v"), F.col("embedding").alias("b"), F.col("label").alias("vl"))


_PAIR = _VEC + ", p as (select q, v, ql, vl, list_cosine_similarity(a, b) as cos, cast((q * 7 + v * 13) % 5 as bigint) as raw from q join v on q <> v)"
_MM = ", n as (select *, case when max(raw) over (partition by q) > min(raw) over (partition by q) then (raw - min(raw) over (partition by q)) / (max(raw) over (partition by q) - min(raw) over (partition by q)) else case when raw > 0 then 1.0 else 0.0 end end as s from p)"


@query(_PAIR + _MM + " select q, v, round(0.6 * greatest(0, least(1, cos)) + 0.4 * s, 6) as score, greatest(0, least(1, cos)) >= 0.35 or raw >= 2 as included from n")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = vectors_of(spark, sf_dir)
    raw = (F.col("q") * 7 + F.col("v") * 13) % 5
    # what the scores range over needs no vectors
    ranges = cut(retrieve.by_blocks(q.select("q"), "q", v.select("v"), "v").where("q <> v").groupBy("q").agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi")))
    return retrieve.hybrid(vectors.pairs(q, v).select("q", "v", "cos", raw.alias("raw")), "q", small(ranges)).select("q", "v", "score", "included")


@query("select user_id, event_id, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else case when value > 0 then 1.0 else 0.0 end end, 6) as scaled from events window w as (partition by user_id)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return retrieve.minmax(e, "value", "user_id").select("user_id", "event_id", F.round("scaled", 6).alias("scaled"))


@query(_PAIR + " select q, v, cast(r as int) as place, round(cos, 5) as cos from (select *, row_number() over (partition by q order by cos desc, v) as r from p) where r <= 8")
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(vectors.best(*vectors_of(spark, sf_dir), 8).select("q", "v", "cos"), "q", "cos", "v", 8).select("q", "v", "place", F.round("cos", 5).alias("cos"))


@query(_PAIR + """, r as (select *, row_number() over (partition by q order by cos desc, v) as r from p), h as (select q, count(*) filter (vl = ql and r <= 8) as found, min(r) filter (vl = ql) as first, count(*) filter (vl = ql) as rel from r group by q)
 select round(avg(found / least(rel, 8)), 6) as recall, round(avg(coalesce(1 / first, 0)), 6) as mrr, cast(count(*) as bigint) as queries from h""")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.recall(*vectors_of(spark, sf_dir), 8)


@query("""with v as (select vec_id, cast(embedding as double[]) as e, label, vec_id // 25 as doc from embeddings)
 select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 5) as cos from v a join v b on a.doc = b.doc and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.3""")
def cluster_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within one document (25 vectors); the threshold is lowered to what these vectors have."""
    v = load(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.expr("vec_id div 25").alias("doc"))
    b = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("f"), "doc")
    p = v.join(b, "doc").where("vec_id < b").withColumn("cos", retrieve.cosine(F.col("embedding"), F.col("f"))).where("cos >= 0.3")
    return p.select(F.col("vec_id").alias("a"), "b", F.round("cos", 5).alias("cos"))


_QIN = "p as (select item_id, doc_id, d.text as body, lang, source, n_chars from (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as quote from benchmark) b join (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) d on contains(d.t, b.quote) where quote <> '')"


@query(f"with {_QIN} select item_id, doc_id from p")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.contained(load(spark, sf_dir, "benchmark").select("item_id", "text"), docs(spark, sf_dir).select("doc_id", "text"))


_CLAIM = f"""with {_QIN}, e as (select p.item_id, p.doc_id, sha256(body) as h, case when n_chars >= 3000 then 'G5' when n_chars >= 1000 then 'G4' else 'G3' end as grade, source, coalesce(l.toxic, 0) as toxic from p left join labels l on l.doc_id = p.doc_id),
 a as (select item_id, count(*) as nominal, count(distinct h) as clusters, min(grade) as grade, max(toxic) as toxic, bool_or(source in ('src3', 'src7')) as ugc from e group by item_id),
 c as (select b.item_id, case b.item_id % 3 when 0 then 'K-L-T' when 1 then 'K-L-A' else 'K-D' end as kind, coalesce(nominal, 0) as nominal, coalesce(clusters, 0) as clusters, coalesce(grade, 'G0') as grade, coalesce(toxic, 0) as toxic, coalesce(ugc, false) as ugc from benchmark b left join a on a.item_id = b.item_id),
 r as (select *, case when nominal = 0 then 1 when kind = 'K-L-A' then 2 else 3 end as base, case when kind = 'K-L-A' then 2 else 1 end as k from c),
 s as (select *, greatest(1, base - case when clusters < k then 1 else 0 end) as s1 from r), t as (select *, case when grade = 'G0' then 0 when grade <> 'G5' then least(s1, 2) else s1 end as s2 from s),
 u as (select *, case when s2 = 0 then 0 when ugc then greatest(1, s2 - 1) else s2 end as s3 from t)
 select item_id, kind, case when nominal = 0 then 'not_covered' when toxic = 1 then 'contested' when s3 = 3 then 'verified' when s3 = 2 then 'attributed' when s3 = 1 then 'unverified' else 'not_covered' end as status, cast(nominal as bigint) as nominal, cast(clusters as bigint) as clusters, grade from u"""


@query(_CLAIM)
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: items are claims, the documents that hold them their evidence; each claim leaves with a status."""
    items, d = load(spark, sf_dir, "benchmark").select("item_id", "text"), docs(spark, sf_dir).select("doc_id", "text", "source", "n_chars")
    toxic = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    grade = F.when(F.col("n_chars") >= 3000, "G5").when(F.col("n_chars") >= 1000, "G4").otherwise("G3")
    found = retrieve.contained(items, d.select("doc_id", "text")).join(d.select("doc_id", F.sha2("text", 256).alias("h"), grade.alias("grade"), "source"), "doc_id").join(toxic, "doc_id", "left")
    own = found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("nominal"), F.countDistinct("h").alias("clusters"), F.min("grade").alias("grade"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.bool_or(F.col("source").isin("src3", "src7")).alias("ugc"))
    c = items.select("item_id").join(own, "item_id", "left").fillna(0, ["nominal", "clusters", "toxic"]).fillna("G0", ["grade"])
    some, yes = F.col("nominal") > 0, F.lit(True)
    record = c.select(
        "item_id", "nominal", "clusters", "grade", F.when(F.col("item_id") % 3 == 0, "K-L-T").when(F.col("item_id") % 3 == 1, "K-L-A").otherwise("K-D").alias("kind"), F.when(some, "intact").otherwise("not_covered").alias("source_integrity"),
        F.col("grade").alias("evidence_grade"), F.col("clusters").alias("independent_cluster_count"), yes.alias("counter_evidence_searched"), (F.col("toxic") == 1).alias("counter_evidence_found"), F.array(F.lit("GC-1")).alias("mechanism_results"),
        F.when(F.coalesce("ugc", F.lit(False)), F.array(F.lit("F-15"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit("ok").alias("budget_state"), F.lit("A").alias("retention_tier"), yes.alias("question_frozen"),
        some.alias("rerun_gate_passed"), some.alias("anchor_containment_passed"), yes.alias("polarity_scope_passed"), yes.alias("frame_gate_passed"), F.lit(None).cast("boolean").alias("inference_gate_passed"), F.lit(False).alias("chart_extracted"),
        yes.alias("has_verbatim_quote"), F.lit("pass").alias("quote_faithful"), F.when(some, "support").otherwise("unclear").alias("attribution_verdict"))
    return with_status(record).select("item_id", "kind", "status", "nominal", "clusters", "grade")


@query("""select o_orderkey, 'total ' || cast(cast(floor(o_totalprice) as bigint) as varchar) || '〔' || case o_orderstatus when 'F' then '已验证' when 'O' then '已归因' else '未验证' end || '，来源 ' || cast(count(*) as varchar) || '/独立簇 ' || cast(count(distinct l_suppkey) as varchar) || '〕' as prose
 from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_totalprice, o_orderstatus""")
def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's figure rendered with its mark, sources and clusters; native, as the values are columns."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    own = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("k"))
    mark = F.when(F.col("o_orderstatus") == "F", text_udf.MARKS["verified"]).when(F.col("o_orderstatus") == "O", text_udf.MARKS["attributed"]).otherwise(text_udf.MARKS["unverified"])
    return o.join(own, o["o_orderkey"] == own["l_orderkey"]).select("o_orderkey", F.concat(F.lit("total "), F.floor("o_totalprice").cast("long"), F.lit("〔"), mark, F.lit("，来源 "), F.col("n"), F.lit("/独立簇 "), F.col("k"), F.lit("〕")).alias("prose"))

"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.ann import PermutationIndex
from claimweave.llm.bitsliced import BitSlicedSearch
from claimweave.llm.common import bounded, fold, materialize, table
from claimweave.llm.decontam import decontaminate
from claimweave.llm.exponion import ExponionKMeans
from claimweave.llm.jaccard import JaccardJoin
from claimweave.llm.langid import RankOrderProfiles
from claimweave.llm.licenses import licence_scan
from claimweave.llm.lm import SubwordLatticeModel
from claimweave.llm.packing import best_fit
from claimweave.llm.tokens import token_counts
from claimweave.llm.toxicity import FactorizationMachine
from claimweave.llm.urlfilter import url_filter
from claimweave.llm.wrapper import main_text

#: The rules of op9: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return PermutationIndex().fit(rows).search(rows.where("vec_id % 20 = 0"), rows, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id") % 5 == 0
    model = RankOrderProfiles().fit(docs, where=~held_out)
    return model.predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id") % 7 == 2)
    model = SubwordLatticeModel().fit(docs, train=~F.col("held_out"))
    return model.score(docs, ["doc_id", "held_out"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the label of their id: the largest where one id has several."""
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if bounded(own):
        return docs.join(F.broadcast(own), "doc_id")
    return materialize(docs.join(own, "doc_id"), "labelled")  # texts are shuffled once, not in each pass of the fit


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id") % 5 == 0
    model = FactorizationMachine().fit(labelled(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return model.predict(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = JaccardJoin().components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return best_fit(docs, "n_tokens")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BitSlicedSearch().search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exponion_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExponionKMeans().cluster(table(spark, sf_dir, "embeddings"))


_OP7 = """
with docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from documents),
items as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from benchmark where text is not null and item_id is not null),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[s + 1 : s + 13], ' ') as g from (select item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as s from items where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') as g from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as s from docs, sizes where len(w) >= n)),
occ as (select doc_id, s, grams.n as n, item_id from grams join win on grams.g = win.g and grams.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from occ) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from occ) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit on docs.doc_id = hit.doc_id left join it on docs.doc_id = it.doc_id
"""

_OP9 = """
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as a from pages),
h as (select page_id, a, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u),
p as (select page_id, host, regexp_extract(substr(a, length(host) + 1), '^([^?#]*)', 1) as path from h),
rules(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select host, path, rh || rp as rule, v, row_number() over (partition by host, path order by length(rh || rp) desc) as k
  from (select distinct host, path from p) x join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, p.host as host, p.path as path, rule, coalesce(v, 'allow') as verdict from p left join m on p.host = m.host and p.path = m.path and m.k = 1
"""

_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_OP12 = f"""
with docs as (select doc_id, row_number() over () as r, {_TERMS} as w from documents),
col as (select count(*) as nd, sum(len(w)) as l from docs where len(w) > 0),
asked as (select distinct item_id, t from (select item_id, unnest({_TERMS}) as t from benchmark where item_id is not null)),
post as (select r, any_value(doc_id) as doc_id, any_value(n) as n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from docs) group by r, t),
wt as (select t, cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) as bigint) as wt from (select t, count(*) as df from post where t in (select t from asked) group by t), col),
hit as (select item_id, r, any_value(doc_id) as doc_id, cast(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) as bigint) as score
  from (select r, doc_id, t, tf, n, nd, cast(l as bigint) as l from post, col) join wt using (t) join asked using (t) group by item_id, r)
select item_id, cast(rank as int) as rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from hit where score > 0) where rank <= 50
"""


def _op13(k: int = 40, rounds: int = 5) -> str:
    d = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    near = lambda i: f"a{i} as materialized (select r, vec_id, v, own, d from (select r, vec_id, v, k as own, {d} as d, row_number() over (partition by r order by {d}, k) as best from x, c{i}) where best = 1)"
    parts = [
        "x as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda y: cast(floor(256 * cast(y as double)) as double)) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is not null and isfinite(y))) = 64)",
        f"c0 as materialized (select row_number() over (order by sha256('{2}:' || vec_id), v) - 1 as k, v as c from x where vec_id is not null qualify k < {k})",
    ]
    for i in range(rounds):
        parts += [
            near(i),
            f"s{i} as (select own, p, sum(cast(y as bigint)) as s, count(*) as n from (select own, unnest(v) as y, unnest(range(64)) as p from a{i}) group by own, p)",
            f"m{i} as (select own, list(cast((s - ((s % n) + n) % n) // n as double) order by p) as c from s{i} group by own)",
            f"c{i + 1} as materialized (select k, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on k = own)",
        ]
    return f"""with {", ".join([*parts, near(rounds)])}
select vec_id, cast(own as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by own) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c, lambda y: cast(cast(y as bigint) as varchar)), ',')) as centroid_sha256
from a{rounds} join c{rounds} on own = k"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_permutation_ann, op2_language_id, op3_wrapper_induction, op4_token_counts, op5_subword_lattice, op6_toxicity, op7_decontamination, op8_ngram_jaccard, op9_url_filter, op10_best_fit_packing,
                                  op11_license_scan, op12_bit_sliced_search, op13_exponion_kmeans)}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": _OP7, "op9_url_filter": _OP9, "op12_bit_sliced_search": _OP12, "op13_exponion_kmeans": _op13()}

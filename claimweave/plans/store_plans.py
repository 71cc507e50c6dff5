"""Queries that write stores and logs in the shared folder and read them back, bound to documents, events and all tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text, text_udf
from claimweave.operators import ingest, provenance
from claimweave.operators.graph import shared_folder
from claimweave.plans.registry import query
from claimweave.sources import log
from claimweave.sources.store import Index, KeyedStore
from claimweave.sources.tables import load


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_NORM = "trim(regexp_replace(replace(translate(text, '‘’“”–—' || chr(160), '''''\"\"-- '), '…', '...'), '\\s+', ' ', 'g'))"


@query(f"""with d as (select *, sha256({_NORM}) as h, doc_id % 2 as batch from documents where trim(text) <> ''), f as (select h, min(batch) as batch, arg_min(doc_id, batch * 1000000000 + doc_id) as first, arg_min(source, batch * 1000000000 + doc_id) as base, cast(count(distinct (doc_id % 50, lang)) as bigint) as bindings from d group by h)
 select h as content_hash, row_number() over (order by batch, first) as doc_id, case when p = 0 then base else base || '-' || chr(cast(97 + p as int)) end as citation_key, bindings from (select *, row_number() over (partition by base order by batch, first) - 1 as p from f)""")
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested in two batches, the even ids first: one entry a content, bindings of all that brought it, keys with suffixes."""
    d = load(spark, sf_dir, "documents").where("trim(text) <> ''")
    bindings = F.array(F.struct((F.col("doc_id") % 50).alias("node"), F.col("lang").alias("relation"), F.lit(None).cast("string").alias("note")))
    rows = d.select(F.col("doc_id").alias("seq"), F.sha2(text.norm_v0(F.col("text")), 256).alias("content_hash"), F.lit("web").alias("kind"), F.lit(None).cast("string").alias("title"), F.col("source").alias("base"), bindings.alias("bindings"))
    store = KeyedStore(spark, folder(spark, "entries"), "content_hash", ingest.ENTRY, 16)
    for batch in (0, 1):
        store.upsert(ingest.ingested(store.read(), rows.where(F.col("seq") % 2 == batch)))
    return store.read().select("content_hash", "doc_id", "citation_key", F.size("bindings").cast("long").alias("bindings"))


#: table, key, and which column is hot as state, status, strength, queue_name and kind
TABLES = {
    "region": ("r_regionkey", {}), "nation": ("n_nationkey", {}), "customer": ("c_custkey", {"state": "c_mktsegment"}), "supplier": ("s_suppkey", {}), "part": ("p_partkey", {"kind": "p_type", "strength": "p_brand"}),
    "orders": ("o_orderkey", {"status": "o_orderstatus", "queue_name": "o_orderpriority"}), "lineitem": ("l_orderkey", {"status": "l_linestatus", "state": "l_returnflag"}), "events": ("event_id", {"kind": "event_type"}),
    "documents": ("doc_id", {"kind": "lang", "state": "source"}), "pages": ("page_id", {}), "benchmark": ("item_id", {}), "labels": ("doc_id", {}), "conversations": ("conv_id", {"kind": "role"}),
}


_HOT = ("state", "status", "strength", "queue_name", "kind")


def _counts(name: str, key: str, hot: dict[str, str]) -> str:
    listed = ", ".join((f"count({hot[c]})" if c in hot else "cast(0 as bigint)") + f" as n_{c}" for c in _HOT)
    return f"select '{name}' as name, count(*) as n, count(distinct {key}) as ids, cast(count(*) * (count(*) + 1) // 2 as bigint) as seqs, {listed}, {str(name in ('part', 'labels')).lower()} as stale from {name}"


@query(" union all ".join(_counts(t, *own) for t, own in TABLES.items()))
def index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables built into one index on disk and read back, with those that have changed since (a part renamed, a label turned about)."""
    own = {t: load(spark, sf_dir, t) for t in TABLES}
    index = Index(spark, folder(spark, "index"))
    index.build({t: (own[t], key, hot) for t, (key, hot) in TABLES.items()})
    now = own | {"part": own["part"].withColumn("p_name", F.when(F.col("p_partkey") == 7, "renamed").otherwise(F.col("p_name"))), "labels": own["labels"].withColumn("toxic", 1 - F.col("toxic"))}
    hot = [F.count(c).alias(f"n_{c}") for c in _HOT]
    rows = index.read().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum("seq").alias("seqs"), *hot)
    return rows.join(index.stale(now), "name")


@query("""with e as (select *, row_number() over (order by event_id % 3, event_id) as seq from events) select cast(max(seq) + 1 as bigint) as last, cast(count(*) as bigint) as records, cast(sum(seq * (event_id % 1000)) as bigint) as places, cast(1 as bigint) as corrupt from e""")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in three batches and one broken line behind them, read back with their numbers."""
    path, e = folder(spark, "log"), load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for k in range(3):
        log.append(e.where(F.col("event_id") % 3 == k), path, ["event_id"])
    spark.createDataFrame([('{"event_id": 1, "us',)], "value string").write.text(f"{path}/batch={4:012d}")
    back = log.read_log(log.numbered_lines(spark, path), "event_id long, user_id long, event_type string, value double")
    ok = ~F.col("corrupt")
    return back.agg(F.max("seq").alias("last"), F.count(F.when(ok, 1)).alias("records"), F.sum(F.when(ok, F.col("seq") * (F.col("event_id") % 1000))).alias("places"), F.count(F.when(F.col("corrupt"), 1)).alias("corrupt"))


@query("select doc_id, case when doc_id % 5 = 0 then null else cast(octet_length(encode(text)) as bigint) end as bytes from documents where text is not null")
def cas_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of objects gives for the address of each document; every fifth address is unknown to it."""
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("bytes"))
    asks = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("bytes", F.lit(b"\\x00 not there")), 256)).otherwise(F.sha2("bytes", 256)).alias("address"))
    return provenance.get_objects(asks, provenance.put_objects(d)).select("doc_id", F.octet_length("bytes").cast("long").alias("bytes"))


@query("select item_id, replace(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))), 'ß', 'ss') as folded from benchmark")
def casefold_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed, single blanks, one case."""
    return load(spark, sf_dir, "benchmark").select("item_id", text_udf.casefold("text").alias("folded"))

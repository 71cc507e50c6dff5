"""Provenance of evidence: passages and the round trip of their locators, anchors of snapshots, content-addressed objects, cards, integrity, prose.

What is refused in a record gives its reasons in a column, so that one record cannot fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import structured, text, text_udf

PLACEHOLDER = r"\{\{claim:([A-Za-z0-9_-]+)\.([A-Za-z0-9_]+)\}\}"
ANCHOR = ["object_sha256", "url", "retrieved_at", "http_status", "bytes", "extractor_version"]
CARD_ID = ["work_id", "version_id", "locator", "quote", "extractor_version"]


#: Full texts that go to a Python worker at once.
BATCH = 200


def passages(docs: DataFrame, id_col: str, doc_col: str, kind: str) -> DataFrame:
    """(id, ord, locator, text, sec, title) of full texts of one kind: 'jats' or 'html'. The session's Arrow batches become BATCH rows at most, as a batch holds its texts and all their passages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH:
        docs.sparkSession.conf.set(key, str(BATCH))
    return docs.select(id_col, F.explode(structured.passages_by(structured.PARSERS[kind])(doc_col)).alias("_p")).select(id_col, "_p.*")


def round_trip(asks: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """asks (id, locator, quote) with a verdict: the passage that a locator leads to must hold the quote. 'no_anchor', 'unresolved', 'elsewhere' or 'ok'."""
    first = found.where("locator is not null").groupBy(id_col, "locator").agg(F.min_by("text", "ord").alias("_text"))
    plain = lambda c: text.squeeze(text_udf.nfkc(c))
    verdict = F.when(F.col("locator").isNull(), "no_anchor").when(F.col("_text").isNull(), "unresolved").when(F.contains(plain("_text"), plain("quote")), "ok").otherwise("elsewhere")
    return asks.join(first, [id_col, "locator"], "left").withColumn("verdict", verdict).drop("_text")


def evidence(asks: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """asks (id, quote) as evidence records: the first addressable passage in the order of the page that holds the quote (composed forms, blanks squeezed), and whether its locator leads back to it.

    Without such a passage the locator is 'unaddressable' and the record is not verified, but it stays: it only cannot have the best grade. Each quote of a text meets that text's passages alone.
    """
    plain = lambda c: text.squeeze(text_udf.nfkc(c))
    own = asks.withColumn("_plain", plain("quote"))
    # of passages with one locator the first is where it leads; a passage behind it that holds the quote is found, and does not lead back
    at = found.where("locator is not null").select(id_col, "locator", "ord", plain("text").alias("_text"))
    at = at.join(at.groupBy(id_col, "locator").agg(F.min("ord").alias("_lead")), [id_col, "locator"])
    lead = at.where("ord = _lead").select(id_col, "locator", F.col("_text").alias("_there"))
    pairs = own.select(id_col, "_plain").where("_plain is not null").distinct().join(at, id_col).where(F.contains("_text", F.col("_plain")))
    first = pairs.groupBy(id_col, "_plain").agg(F.min_by("locator", "ord").alias("locator"), F.min("ord").alias("ord"))
    told = own.join(first, [id_col, "_plain"], "left").join(lead, [id_col, "locator"], "left")
    verified = F.coalesce(F.contains("_there", F.col("_plain")), F.lit(False))
    return told.select(*asks.columns, F.coalesce("locator", F.lit("unaddressable")).alias("locator"), "ord", verified.alias("roundtrip_verified"))


def blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def reasons(*cases: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), name) for wrong, name in cases]))


def build_anchors(fetches: DataFrame) -> DataFrame:
    """fetches (url, body, http_status, retrieved_at, extractor_version) with the anchor's columns object_sha256 and bytes, null where `problems` is not empty."""
    at = F.try_to_timestamp("retrieved_at")
    wrong = reasons(
        (~F.col("url").rlike("(?i)^https?://"), "url"), (F.col("body").isNull(), "body"), (F.col("http_status") != 200, "http_status"),
        (at.isNull(), "retrieved_at"), (blank("extractor_version"), "extractor_version"), (F.octet_length("body") == 0, "bytes"),
    )
    own = fetches.withColumn("problems", wrong)
    sound = F.size("problems") == 0
    return own.withColumns({"object_sha256": F.when(sound, F.sha2("body", 256)), "bytes": F.when(sound, F.octet_length("body").cast("long"))})


def anchor_fault() -> Column:
    """What is wrong with a stored anchor, null where nothing is: missing fields, the form of its digest, its status, its size."""
    missing = F.array_compact(F.array(*[F.when(blank(c), c) for c in ANCHOR]))
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(~F.col("object_sha256").rlike("^[0-9a-f]{64}$"), "object_sha256").when(F.col("http_status") != 200, "http_status").when(F.col("bytes") <= 0, "bytes")
    )


def normal_quote(c: str | Column) -> Column:
    return text.normalize_quote(text_udf.nfkc(c))


def with_card_id(cards: DataFrame) -> DataFrame:
    """cards with evidence_id, the digest of its five parts, and the missing ones; without all parts there is no id."""
    parts = [normal_quote("quote") if c == "quote" else F.col(c) for c in CARD_ID]
    missing = F.array_compact(F.array(*[F.when(blank(c), c) for c in CARD_ID]))
    return cards.withColumn("missing", missing).withColumn("evidence_id", F.when(F.size("missing") == 0, F.sha2(F.concat_ws(" ", *parts), 256)))


def put_objects(blobs: DataFrame) -> DataFrame:
    """(address, bytes) of distinct contents. Contents are grouped by digest before any is kept."""
    return blobs.where("bytes is not null").groupBy(F.sha2("bytes", 256).alias("address")).agg(F.first("bytes").alias("bytes"))


def get_objects(asks: DataFrame, store: DataFrame) -> DataFrame:
    """asks (address, ...) with the bytes that a store (address, bytes) has for them; null where it has none, or has others than the address says."""
    own = store.where(F.sha2("bytes", 256) == F.col("address")).select("address", "bytes")
    return asks.join(own, "address", "left")


def integrity(asks: DataFrame, cards: DataFrame, objects: DataFrame) -> DataFrame:
    """asks (evidence_id) with a verdict: 'not_covered' (no card), 'missing' (no object), 'mutated' (other bytes, or the quote is gone) or 'intact'.

    cards (evidence_id, object_sha256, quote) and objects (address, bytes) are unique by their first columns. Each object is normalized once, whatever its cards.
    """
    store = objects.select("address", (F.sha2("bytes", 256) == F.col("address")).alias("_whole"), normal_quote(F.col("bytes").cast("string")).alias("_body"))
    own = cards.select("evidence_id", "object_sha256", normal_quote("quote").alias("_quote"))
    told = own.join(store, F.col("object_sha256") == F.col("address"), "left").select(
        "evidence_id", F.when(F.col("address").isNull(), "missing").when(F.col("_whole") & F.contains("_body", "_quote"), "intact").otherwise("mutated").alias("verdict")
    )
    return asks.join(told, "evidence_id", "left").fillna("not_covered", ["verdict"])


def compose(skeletons: DataFrame, claims: DataFrame) -> DataFrame:
    """skeletons (id, skeleton) with prose or a denial. claims: (claim_id, fields map, status, sources, clusters), unique by claim_id.

    Each placeholder becomes its field's value with the claim's mark and, where both are known, sources and clusters. Bare numbers, placeholders
    that lead nowhere, and digits without any placeholder deny the whole skeleton.
    """
    whole, claim, field = (F.regexp_extract_all("skeleton", F.lit(PLACEHOLDER), F.lit(k)) for k in range(3))
    asked = skeletons.select("id", F.posexplode(F.arrays_zip(claim.alias("claim_id"), field.alias("field"))).alias("k", "a")).select("id", "k", "a.claim_id", "a.field")
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in text_udf.MARKS.items() for x in kv]), F.col("status")), F.concat(F.lit("?"), F.col("status")))
    counts = F.coalesce(F.concat(F.lit("，来源 "), F.col("sources"), F.lit("/独立簇 "), F.col("clusters")), F.lit(""))
    known = F.coalesce(F.map_contains_key("fields", F.col("field")), F.lit(False))
    shown = F.when(known, F.concat(F.coalesce(F.element_at("fields", F.col("field")), F.lit("null")), F.lit("〔"), mark, counts, F.lit("〕")))
    told = asked.join(claims, "claim_id", "left").select("id", F.struct("k", shown.alias("shown"), F.concat("claim_id", F.lit("."), "field").alias("name")).alias("one"))
    # a skeleton's own placeholders only
    told = told.groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    bare = text_udf.rowwise(lambda t: ",".join(text_udf.bare_numbers(t)), F.col("skeleton"))
    own = skeletons.withColumn("bare", bare).withColumn("literals", F.split("skeleton", PLACEHOLDER, -1)).withColumn("whole", whole).join(told, "id", "left")
    lost = F.transform(F.filter("ones", lambda x: x["shown"].isNull()), lambda x: x["name"])
    denial = (
        F.when(F.col("bare") != "", F.concat(F.lit("bare "), F.col("bare"))).when(F.size(F.coalesce(lost, F.array().cast("array<string>"))) > 0, F.concat(F.lit("missing "), F.array_join(lost, ",")))
        .when((F.size("whole") == 0) & F.col("skeleton").rlike("[0-9]"), "no placeholder")
    )
    filled = F.coalesce(F.transform("ones", lambda x: x["shown"]), F.array().cast("array<string>"))
    prose = F.array_join(F.zip_with("literals", filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return own.withColumn("denial", denial).select("id", F.when(F.col("denial").isNull(), prose).alias("prose"), "denial")

"""Ledgers: what calls cost, what sources are known for, how well targets are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: USD per million tokens (cache hit, cache miss, output) off peak; peak hours cost double
PRICES = {"deepseek-v4-flash": (0.007, 0.22, 0.66), "deepseek-v4-pro": (0.022, 0.66, 1.98)}
TIERS = {"official_report": "T1_official", "peer_reviewed": "T2_peer_reviewed", "working_paper": "T3_working_paper", "dataset": "T4_industry_data", "news": "T5_press", "user_notes": "T6_other"}
OTHER_TIER = "T6_other"
TLDS = ["com", "org", "net", "gov", "edu", "io", "co", "uk", "us", "int", "ac"]
ANGLE_RANK = {"no_attempt": 0, "tried_empty": 1, "tried_blocked": 2, "productive": 3}


def peak(at: Column) -> Column:
    h = F.hour(at)
    return ((h >= 1) & (h < 4)) | ((h >= 6) & (h < 10))


def priced(calls: DataFrame) -> DataFrame:
    """calls (model, hit, miss, output, called_at) with is_peak and usd; an unknown model fails the query."""
    table = F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.array(*map(F.lit, p)))])
    price = F.coalesce(table[F.col("model")], F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("array<double>"))
    usd = (F.col("hit") / 1e6 * F.col("p")[0] + F.col("miss") / 1e6 * F.col("p")[1] + F.col("output") / 1e6 * F.col("p")[2]) * F.when(F.col("is_peak"), 2).otherwise(1)
    return calls.withColumn("p", price).withColumn("is_peak", F.coalesce(peak(F.col("called_at")), F.lit(False))).withColumn("usd", usd).drop("p")


def by_stage(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("stage", F.lit("(none)")).alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("hit") + F.col("miss") + F.col("output")).alias("tokens"), F.round(F.sum("usd"), 6).alias("usd"))


def by_outcome(calls: DataFrame, statuses: DataFrame) -> DataFrame:
    """By the status of the claim a call was for: cost in all and a claim."""
    own = calls.join(statuses, "claim", "left").groupBy(F.coalesce("status", F.lit("(none)")).alias("status")).agg(F.sum("usd").alias("u"), F.countDistinct("claim").alias("claims"))
    return own.select("status", "claims", F.round("u", 6).alias("usd"), F.round(F.when(F.col("claims") > 0, F.col("u") / F.col("claims")), 6).alias("usd_per_claim"))


def estimate_tokens(text: Column) -> Column:
    """One a CJK or full-width character, a quarter for each other."""
    wide = F.length(text) - F.length(F.regexp_replace(text, r"[　-鿿＀-￯]", ""))
    return F.ceil(wide + (F.length(text) - wide) / 4).cast("long")


def upsert(known: DataFrame, seen: DataFrame) -> DataFrame:
    """A domain's encounters summed, its best tier ever, blocked if ever blocked, its publisher or else its domain."""
    every = known.unionByName(seen)
    return every.groupBy("domain").agg(F.sum("seen_count").alias("seen_count"), F.min("tier").alias("tier"), F.bool_or("blocked").alias("blocked"), F.coalesce(F.min("publisher"), F.col("domain")).alias("publisher"))


def tier_changes(profiles: DataFrame, seq: str) -> DataFrame:
    """Versions of a domain whose tier differs from the one before without a note."""
    w = Window.partitionBy("domain").orderBy(seq)
    return profiles.withColumn("was", F.lag("tier").over(w)).where(F.col("was").isNotNull() & (F.col("was") != F.col("tier")) & ~F.coalesce("noted", F.lit(False)))


def matches_facet(domain: Column, publisher: Column, tier: Column, facet: Column) -> Column:
    """Official sources always; else the facet names the domain or the publisher, or has a label of the domain, no TLD, as a whole word."""
    named = lambda c: (c != "") & F.contains(F.lower(facet), F.lower(c))
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda x: (x != "") & ~x.isin(*TLDS))
    words = F.regexp_extract_all(F.lower(facet), F.lit("[a-z0-9]+"), F.lit(0))
    return (tier == "T1_official") | named(domain) | named(publisher) | F.arrays_overlap(labels, words)


def best_angle(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """An angle's outcome: the best of all its attempts."""
    rank = F.create_map(*[F.lit(x) for kv in ANGLE_RANK.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, r in ANGLE_RANK.items() for x in (r, k)])
    return attempts.groupBy(*keys).agg(F.max(rank[F.col("outcome")]).alias("r")).select(*keys, name[F.col("r")].alias("outcome"))


def coverage(targets: DataFrame, bindings: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a target: directions, documents, publishers (the empty one counts as one) and tiers of what is bound to it."""
    own = bindings.join(documents, "doc", "left")
    low = F.col("tier").isin("T3_working_paper", "T4_industry_data")
    total = lambda c: F.sum(c).alias(c)
    count = lambda when, name: F.count(F.when(when, 1)).alias(name)
    direction = lambda d: count(F.coalesce("direction", F.lit("context")) == d, d)
    # several distinct counts at once would multiply the bindings: those of a target and a document are folded first, then a target's documents
    folded = own.groupBy("target", "doc", "publisher", "tier").agg(F.count("doc").alias("bindings"), *map(direction, ("supports", "refutes", "context")))
    some = lambda c, when=F.lit(True): F.size(F.collect_set(F.when(when, F.col(c)))).cast("long")
    folded = folded.groupBy("target").agg(
        *map(total, ("bindings", "supports", "refutes", "context")),
        some("doc").alias("docs"), some("publisher").alias("distinct_publishers"), F.array_join(F.sort_array(F.collect_set("tier")), ",").alias("tiers"),
        F.max(F.col("tier").isin("T1_official", "T2_peer_reviewed").cast("int")).alias("t12"), some("doc", low).alias("t34_docs"), some("publisher", low & (F.col("publisher") != "")).alias("t34_publishers"))
    rows = targets.join(folded, "target", "left").fillna(0).fillna("", ["tiers"])
    tri = ((F.col("t12") > 0) & (F.col("docs") >= 2)) | ((F.col("t34_docs") >= 2) & (F.col("t34_publishers") >= 2))
    return rows.withColumn("triangulated", tri).drop("t12", "t34_docs", "t34_publishers")

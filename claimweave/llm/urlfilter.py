"""Operator 9. URL filters by expressions, short hash prefixes and full digests.

Each distinct (host, path) expands into every host suffix (at label borders) with every path prefix of a length that
some rule has. Expressions meet the rules by an equi-join on the first four bytes of their SHA-256; the full
digest then confirms, and the longest rule wins (longest rule string, then longest host, then block before allow).

Host and path are exactly what stands in the URL: ports, user names and trailing dots belong to the host, and an empty
path starts with no rule's path but an empty one.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; repeated rows give
repeated results; rules with a null host or path take no part; without rules every verdict is the default; other columns
are kept, whatever their names, and columns called host, path, rule or verdict are replaced (the URL's own column may have such a name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import ascii_lower, bounded, fresh

#: Parts that a hot expression is dealt to where the rules are too many to broadcast.
SALT = 16


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    return ascii_lower(host), path


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict."""
    digest = F.sha2(F.concat_ws("\n", "x_host", "x_path"), 256)
    rules = (
        rules.select(ascii_lower(F.col("host").cast("string")).alias("x_host"), F.col("path").cast("string").alias("x_path"), F.col("verdict").cast("string").alias("v"))
        .where("x_host is not null and x_path is not null")
        .groupBy("x_host", "x_path").agg(F.max("v").alias("v"))  # a rule given both ways blocks
        .withColumn("full", digest).withColumn("short", F.substring("full", 1, 8))
    )
    lengths = [r[0] for r in rules.select(F.length("x_path").alias("n")).distinct().orderBy("n").collect()]  # path lengths: some hundreds
    host, path = host_path(F.col(f"`{url_col}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]), lambda p: p.isNotNull())
    small = bounded(rules, row_bytes=F.length("x_host") + F.length("x_path") + F.lit(120))
    expressions = (
        rows.select("host", "path").distinct()
        .withColumn("x_host", F.explode(suffixes)).withColumn("x_path", F.explode(prefixes))
        .withColumn("full", digest).withColumn("short", F.substring("full", 1, 8))
    )
    keys = ["short"]
    if not small:  # com/ and its like are expressions of very many URLs: deal them and copy the rules
        expressions = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)))
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        keys = ["short", "salt"]
    r = rules.select(*keys, F.col("full").alias("r_full"), "v")
    hits = expressions.join(F.broadcast(r) if small else r, keys).where("full = r_full")
    weight = F.struct(F.length("x_host") + F.length("x_path"), F.length("x_host"), "v", "x_host", "x_path")
    b_host, b_path = fresh(rows, "b_host", "b_path")
    best = hits.groupBy("host", "path").agg(F.max(weight).alias("b")).select(F.col("host").alias(b_host), F.col("path").alias(b_path), F.concat("b.x_host", "b.x_path").alias("rule"), F.col("b.v").alias("verdict"))
    # a hot URL's pages are split by Spark's own treatment of skewed joins, as no aggregation stands on this join
    on = (F.col("host") == F.col(b_host)) & (F.col("path") == F.col(b_path))
    return rows.join(best, on, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(b_host, b_path)

"""How many sources are independent: one clustering with its log.

Rules are tried in order: equal content, near-equal text, identifiers, title with first author, cited source, common upstream, self-citing group. Every rule gives links; the clusters are what all links
connect, and the log names for each merge the first rule that makes it. That is a spanning forest of least links: each round every cluster takes its least link to another cluster (by rule,
then by the records it joins), all links taken are logged, and the clusters they join become one (Borůvka's algorithm). Every round at least halves the clusters that have links left, so rounds grow with
the logarithm of the records. A group of n records of one key gives n - 1 links, to its least record. Likely identities that no rule proves (similar titles, common authors, a rare number) are proposed and merge nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import cluster
from claimweave.operators.graph import cut, remove, written

RULES = ["same-content-sha256", "near-duplicate", "exact-id", "same-title-first-author", "citation-chain", "cross-language-chain", "self-citation-loop"]
#: Rules that can be wrong: their merges are marked for review.
NEAR_RULE = 1


def links(refs: DataFrame) -> DataFrame:
    """(rule, source, target): what the rules say of refs (id, object_sha256, anchor, doi, arxiv_id, work_id, title, authors, cites_source_id, upstream_id, self_cite_group)."""
    keyed = cut(cluster.with_keys(refs.withColumn("author", F.get("authors", F.lit(0)))))
    stars = {0: "object_sha256", 2: "exact_key", 3: "ta_key", 5: "upstream_id", 6: "self_cite_group"}
    parts = [cluster.star(keyed.withColumn("_key", F.col(key).cast("string")).where("_key <> ''"), "_key", "").select(F.lit(rule).alias("rule"), "source", "target") for rule, key in stars.items()]
    # texts that are equal are one for the search of near ones, and linked by a star
    said = keyed.where("anchor is not null").select("id", F.trim(F.regexp_replace(F.lower("anchor"), r"(?U)\s+", " ")).alias("text")).where("length(text) >= 5")
    near = cluster.near_duplicates(cluster.distinct_texts(said), texts=said).select(F.col("b").alias("source"), F.col("a").alias("target")).union(cluster.star(said, "text", "").select("source", "target"))
    cites = keyed.select(F.col("id").alias("source"), F.col("cites_source_id").alias("target")).join(keyed.select(F.col("id").alias("target")), "target", "left_semi").where("source <> target").select("source", "target")
    parts += [near.select(F.lit(NEAR_RULE).alias("rule"), "source", "target"), cites.select(F.lit(4).alias("rule"), "source", "target")]
    both = reduce(DataFrame.union, parts)
    return both.select("rule", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).groupBy("source", "target").agg(F.min("rule").alias("rule")).select("rule", "source", "target")


def grown(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(log, roots): the forest of the least edges (rule, source, target), and (id, root) of the records that it joins, root being the least of a cluster. None where there is no edge.

    A round: every cluster points along its least edge; of two that point at each other the smaller one is a root; pointers are halved until all point at roots.
    """
    left = written(edges.select(F.struct("rule", "source", "target").alias("e"), F.col("source").alias("a"), F.col("target").alias("b")))
    logged, label = [], None
    while left.limit(1).count():
        each = left.select(F.col("a").alias("c"), F.struct("e", F.col("b").alias("o")).alias("x")).union(left.select(F.col("b"), F.struct("e", F.col("a").alias("o"))))
        chosen = written(each.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.e", "x.o"))
        logged.append(chosen.select("e").distinct().select("e.rule", "e.source", "e.target"))
        back = chosen.select(F.col("c").alias("o"), F.col("o").alias("_back"))
        to = written(chosen.join(back, "o").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p")))
        while True:
            step = written(to.join(to.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", "p", "pp"))
            remove(to)
            to = step.select("c", F.col("pp").alias("p"))
            if not step.where("p <> pp").limit(1).count():
                break
        before = label
        label = to.select(F.col("c").alias("id"), F.col("p").alias("root")) if label is None else label.join(to.select(F.col("c").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        label = written(label)
        end = lambda c: to.select(F.col("c").alias(c), F.col("p").alias(f"_{c}"))
        moved = left.join(end("a"), "a").join(end("b"), "b").select("e", F.col("_a").alias("a"), F.col("_b").alias("b"))
        # of the edges between two clusters the least is enough
        last, left = left, written(moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")).select("e", "a", "b"))
        remove(last, to, *([before] if before is not None else []))
    if not logged:
        return None, None
    least = label.groupBy("root").agg(F.min("id").alias("least"))
    return reduce(DataFrame.union, logged), label.join(least, "root").select("id", F.col("least").alias("root"))


def forest(edges: DataFrame) -> DataFrame:
    """(rule, source, target) of a spanning forest of the least edges, in the order of rule, source, target."""
    log = grown(edges)[0]
    return edges.where("false").select("rule", "source", "target") if log is None else log


def clusters(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): every record with the least record of its cluster; edges: those of a forest, or all links."""
    root = grown(edges)[1]
    own = refs.select("id").distinct()
    return own.select("id", F.col("id").alias("root")) if root is None else own.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def named(log: DataFrame) -> DataFrame:
    """The log with the names of its rules and whether a merge is exact or near."""
    rule: Column = F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1)
    return log.select(F.col("source"), "target", rule.alias("rule"), F.when(F.col("rule") == NEAR_RULE, "near").otherwise("exact").alias("level"))


def candidates(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, rule) of likely identities between clusters: 'similar-title' (overlap of words of 0.8 or more, or equal), 'common-authors' (0.9), 'same-rare-number'. They merge nothing.

    Records with one title, one list of authors or one rare number are each proposed with the least record of theirs, which stands for all pairs of a group.
    """
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != ""))
    people = F.array_distinct(F.transform("authors", lambda a: F.trim(F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}]+", " "))))
    out = []
    for rule, listed, least in (("similar-title", words, 0.8), ("common-authors", people, 0.9)):
        own = cut(refs.select("id", F.array_sort(listed).alias("words")).where(F.size("words") > 0).withColumn("key", F.array_join("words", "\u0001")))
        same = cluster.star(own, "key", rule).select(F.col("target").alias("a"), F.col("source").alias("b"))
        near = cluster.similar_sets(own.select("id", "words"), least).select("a", "b")
        out.append(same.union(near).withColumn("rule", F.lit(rule)))
    numbers = refs.select("id", F.explode(text.rare_numbers(F.col("anchor"))).alias("key"))
    out.append(cluster.star(numbers, "key", "").select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit("same-rare-number").alias("rule")))
    r = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"_{end}"))
    return reduce(DataFrame.union, out).join(r("a"), "a").join(r("b"), "b").where("_a <> _b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rule").distinct()

"""The spine of a graph of claims, what freezing it takes in, and the checklists over it.

nodes: (id, node_type, state, reason, lane, layer); edges: (id, source, target, edge_type, state). Node and edge ids do not meet. A walk goes back from the one thesis along active
edges that support or are depended on, a join a level; nothing but the two heads comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.graph import closure, cut

OPEN = ("queued", "claimed", "running", "blocked")


def heads(nodes: DataFrame) -> tuple[int, int] | None:
    """The ids of the one question and the one thesis, if there is one of each and both are active."""
    own = nodes.where(F.col("node_type").isin("question", "thesis")).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("state").alias("state")).collect()  # two rows
    found = {r["node_type"]: r["id"] for r in own if r["n"] == 1 and r["state"] == "active"}
    return (found["question"], found["thesis"]) if len(found) == 2 else None


def walked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes reached, active edges into them, the edge from thesis to question)."""
    ends = heads(nodes)
    if ends is None:
        return None
    question, thesis = ends
    active = nodes.where("state = 'active'").select(F.col("id").alias("source"))
    live = edges.where("state = 'active' and edge_type in ('supports', 'depends_on')")
    back = live.join(active, "source", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target"))
    start = nodes.where(F.col("id") == thesis).select(F.col("id").alias("node"))
    reached = cut(closure(start, back).select("node"))
    into = live.join(reached.withColumnRenamed("node", "target"), "target", "left_semi")
    head = live.where((F.col("source") == thesis) & (F.col("target") == question) & (F.col("edge_type") == "supports"))
    # of several edges from thesis to question one is enough
    head = head.groupBy("source", "target").agg(F.min("id").alias("id"))
    return reached.union(nodes.where(F.col("id") == question).select("id")).distinct(), into, head


def nothing(nodes: DataFrame) -> DataFrame:
    return nodes.where("false").select(F.lit("node").alias("kind"), "id")


def records(found: tuple[DataFrame, DataFrame, DataFrame], into: DataFrame) -> DataFrame:
    edge = into.select("id").union(found[2].select("id")).distinct()
    return found[0].select(F.lit("node").alias("kind"), F.col("node").alias("id")).union(edge.select(F.lit("edge"), "id"))


def spine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id): question, thesis, the edge between them, and all active edges and sources that lead to the thesis. An edge is in only where its source is active. Without heads there is none."""
    if (found := walked(nodes, edges)) is None:
        return nothing(nodes)
    active = nodes.where("state = 'active'").select(F.col("id").alias("source"))
    return records(found, found[1].join(active, "source", "left_semi"))


def freeze(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id): what freezing takes in: the same walk, with each edge before its source is looked at."""
    return nothing(nodes) if (found := walked(nodes, edges)) is None else records(found, found[1])


def lanes_complete(lanes: DataFrame, expansions: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(lane, complete): whether a closing (empty) expansion (lane, added) of a lane has committed and no open item (target, status) is on its records: its nodes and the edges that leave them."""
    closing = expansions.where("added = 0").select("lane").distinct().withColumn("closed", F.lit(True))
    own = nodes.select("lane", "id")
    mine = own.union(edges.select("id", "source").join(own.withColumnRenamed("id", "source"), "source").select("lane", "id"))
    busy = mine.join(items.where(F.col("status").isin(*OPEN)).select(F.col("target").alias("id")).distinct(), "id", "left_semi").select("lane").distinct().withColumn("busy", F.lit(True))
    return lanes.join(closing, "lane", "left").join(busy, "lane", "left").select("lane", (F.col("closed").isNotNull() & F.col("busy").isNull()).alias("complete"))


def sweep_floor(nodes: DataFrame, requested: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, met) of the seed claims (facts and mechanisms of the first layer that are not rejected): two units of evidence (target, unit, doc) from two documents asked for them, or two searches (target, status) that found nothing."""
    seeds = nodes.where("layer = 0 and node_type in ('fact', 'mechanism') and state <> 'rejected'").select("id")
    a = requested.groupBy(F.col("target").alias("id")).agg(F.count_distinct("unit").alias("units"), F.count_distinct("doc").alias("docs"))
    b = requests.where("status = 'not_found'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
    met = F.coalesce((F.col("units") >= 2) & (F.col("docs") >= 2), F.lit(False)) | (F.coalesce("lost", F.lit(0)) >= 2)
    return seeds.join(a, "id", "left").join(b, "id", "left").select("id", met.alias("met"))


def checklist(nodes: DataFrame, edges: DataFrame, floors: DataFrame, items: DataFrame, lanes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(item, pass): the nine conditions of a minimal structure. floors: (id, met); lanes: (lane, complete); gaps: what the last dry run still misses.

    What holds of all of none holds; but a spine and lanes there must be (3 and 7).
    """
    own = cut(spine(nodes, edges))
    in_spine = own.where("kind = 'node'").select("id")
    proof = nodes.join(in_spine, "id", "left_semi").where("node_type in ('fact', 'mechanism')")
    state = nodes.select(F.lit("node").alias("kind"), "id", "state").union(edges.select(F.lit("edge"), "id", "state"))
    every, some = lambda c: F.coalesce(F.bool_and(c), F.lit(True)), lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    # an item touches the spine on a record of it, on an edge with an end in it, or on a child's node
    beside = own.select("id").union(edges.join(in_spine.withColumnRenamed("id", "source"), "source", "left_semi").select("id")).union(edges.join(in_spine.withColumnRenamed("id", "target"), "target", "left_semi").select("id"))
    ends = heads(nodes)
    head = edges.where(F.lit(False)) if ends is None else edges.where((F.col("source") == ends[1]) & (F.col("target") == ends[0]) & (F.col("edge_type") == "supports"))
    told = lambda item, df, c: df.agg(c.alias("pass")).select(F.lit(item).alias("item"), "pass")
    none = F.count(F.lit(1)) == 0
    out = F.col("state") == "rejected"
    return reduce(DataFrame.union, [
        told("MSA-1", nodes, F.lit(ends is not None)), told("MSA-2", head.join(own.where("kind = 'edge'"), "id", "left_semi"), F.count(F.lit(1)) > 0),
        told("MSA-3", own.join(state, ["kind", "id"], "left"), every(F.coalesce(F.col("state") == "active", F.lit(False))) & ~none), told("MSA-4", proof.join(floors, "id", "left"), every(F.coalesce("met", F.lit(False)))),
        told("MSA-5", nodes.where("node_type = 'alternative'"), every(out | ((F.col("state") == "parked") & F.coalesce(F.col("reason").isin("absorbed", "not_needed"), F.lit(False))))),
        told("MSA-6", items.where(F.col("status").isin(*OPEN)).join(beside.distinct(), F.col("target") == F.col("id"), "left_semi"), none), told("MSA-7", lanes, every("complete") & ~none), told("MSA-8", gaps, none),
        told("MSA-9", proof, some(F.col("state") == "active"))])

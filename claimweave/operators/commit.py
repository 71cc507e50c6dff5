"""Commits: the versions that a verdict or an owner's order appends to a record, and the queue operations that follow.

Records are (id, kind, state, reason, strength, version, claim, frozen, proof). Logs are only appended to: every transform returns new versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.asof import as_of
from claimweave.operators.graph import cut
from claimweave.operators.sizes import small

MOST_BRIDGES, BRIDGE_ROUNDS = 2, 2
PARK_REASONS = ("absorbed", "not_needed")


def applied(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The next version of each record with a verdict (id, outcome, grade, narrowed, why, proof): pass, narrow, bridge, needs_docs or rejected.

    Only a pass carries a strength; a narrow replaces the claim and raises its version.
    """
    outcome, old = F.col("outcome"), records.drop("state", "reason", "strength", "proof")
    state = F.when(outcome == "pass", "active").when(outcome.isin("narrow", "bridge"), "needs_repair").otherwise(outcome)
    reason = F.when(outcome.isin("narrow", "bridge"), outcome).when(outcome == "rejected", F.col("why"))
    narrow = outcome == "narrow"
    return old.join(verdicts, "id").select(
        "id", "kind", state.alias("state"), reason.alias("reason"), F.when(outcome == "pass", F.col("grade")).otherwise("unassessed").alias("strength"),
        (F.col("version") + narrow.cast("int")).alias("version"), F.when(narrow, F.col("narrowed")).otherwise(F.col("claim")).alias("claim"), "frozen", "proof")


def bridged(gaps: DataFrame, proposals: DataFrame) -> DataFrame:
    """The first two proposals (id, seq, claim, node_type) of each edge with a gap (id, target, lane, rounds), as a node and its edge to the target.

    Edges that had their rounds of bridges get none.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    chosen = proposals.join(gaps.where(F.col("rounds") < BRIDGE_ROUNDS), "id").withColumn("place", first).where(F.col("place") <= MOST_BRIDGES)
    kind = F.when(F.col("node_type") == "definition", "depends_on").otherwise("supports")
    return chosen.select("id", "place", "claim", "node_type", "lane", F.col("target").alias("parent"), kind.alias("edge_type"), F.lit("pending_proof").alias("state"))


def follow_ups(verdicts: DataFrame) -> DataFrame:
    """(id, op, detail) of the queue operations after verdicts (id, outcome, rounds, saturated, floor_met, misses)."""
    outcome, saturated = F.col("outcome"), F.col("saturated")
    item = lambda op, detail=None: F.array(F.struct(F.lit(op).alias("op"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))
    floor = F.concat(F.lit("saturated, floor_met="), F.col("floor_met").cast("string"))
    stop = F.when(F.col("floor_met"), F.concat(item("dead_letter", floor), item("human_review"))).otherwise(item("dead_letter", floor))
    wiring = F.when(F.col("misses") > 0, item("enqueue", F.concat(F.lit("blocked by "), F.col("misses").cast("string")))).otherwise(item("enqueue"))
    ops = (
        F.when(outcome == "narrow", item("enqueue")).when(outcome == "rejected", item("cancel"))
        .when(outcome == "bridge", F.when(F.col("rounds") >= BRIDGE_ROUNDS, item("dead_letter", F.lit("bridge cap reached"))).otherwise(item("enqueue", F.lit("blocked by bridges"))))
        .when(outcome == "needs_docs", F.when(saturated, stop).otherwise(wiring))
    )
    return verdicts.select("id", F.inline(ops))


STATES = ("active", "candidate", "pending_proof", "needs_repair", "needs_docs", "parked", "rejected", "other")
#: Orders of one record that are folded in one row: so many successive numbers of orders.
BLOCK = 128


def _step(s: Column, c: Column) -> Column:
    """The record's state s after the order c; refused says why it changes nothing. state, frozen and proof decide; reason, into and strength follow."""
    op, why, state = c["op"], c["why"], s["state"]
    refused = (
        F.when(op.isNull() | ~op.isin("park", "unpark", "freeze", "unfreeze", "reopen"), "order").when(op == "park", F.when(~state.isin("active", "candidate"), "state").when(s["frozen"], "frozen").when(~F.coalesce(why.isin(*PARK_REASONS), F.lit(False)), "reason").when((why == "absorbed") & ~F.coalesce(c["into_active"], F.lit(False)), "into"))
        .when((op == "unpark") & (state != "parked"), "state")
    )
    back = F.when(s["proven"], "pending_proof").otherwise("candidate")
    new = F.when(op == "park", "parked").when(op == "unpark", back).when(op == "freeze", state).otherwise("pending_proof")
    keep = refused.isNotNull()
    kept = lambda name, value: F.when(keep, s[name]).otherwise(value).alias(name)
    return F.struct(
        kept("state", new), kept("frozen", F.when(op == "freeze", True).when(op == "unfreeze", False).otherwise(s["frozen"])), s["proven"].alias("proven"),
        kept("reason", F.when(op == "park", why).when(op.isin("unpark", "reopen"), F.lit(None)).otherwise(s["reason"])), kept("into", F.when(op == "park", F.when(why == "absorbed", c["into"])).when(op == "unpark", F.lit(None)).otherwise(s["into"])),
        kept("strength", F.when(op == "freeze", s["strength"]).otherwise("unassessed")), c["cmd"].alias("cmd"), op.alias("op"), refused.alias("refused"), (~keep & (op.isin("unfreeze", "reopen") | ((op == "unpark") & s["proven"]))).alias("queued"))


def _given(state: Column, frozen: Column, proven: Column, reason: Column, into: Column, strength: Column, some: Column) -> Column:
    """The state of a fold before any order. some: a condition that always holds, though no optimizer knows: what a fold starts from must be nullable where its steps give nulls."""
    reason, into = F.when(some, reason), F.when(some, into)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return F.struct(state.alias("state"), frozen.alias("frozen"), proven.alias("proven"), reason.alias("reason"), into.alias("into"), strength.alias("strength"), none("long", "cmd"), none("string", "op"), none("string", "refused"), F.lit(False).alias("queued"))


def _known(records: DataFrame) -> DataFrame:
    return records.select("id", "state", "frozen", F.col("proof").isNotNull().alias("proven"), "reason", F.lit(None).cast("long").alias("into"), "strength")


def _folded(blocks: DataFrame, given: list[Column]) -> DataFrame:
    """(id, and the fields of _step) after every order of a list, from the state that is given."""
    whole = blocks.withColumn("s", _given(*given, F.size("orders") >= 0))
    each = F.aggregate("orders", F.array("s"), lambda acc, c: F.concat(acc, F.array(_step(F.element_at(acc, -1), c))))
    return whole.select("id", F.explode(F.slice(each, 2, BLOCK)).alias("s")).select("id", "s.*")


def _listed(orders: DataFrame, *keys: Column | str) -> DataFrame:
    return orders.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cmd", "op", "why", "into", "into_active"))).alias("orders"))


def _replay(records: DataFrame, orders: DataFrame, long: DataFrame | None) -> DataFrame:
    """(id, and the fields of _step) after every order (cmd, id, op, why, into, into_active), those of a record one after another. long: the records (id) with more than BLOCK orders, if any; the orders of others are one list."""
    at_first = [F.col(c) for c in ("state", "frozen", "proven", "reason", "into", "strength")]
    few = orders if long is None else orders.join(long, "id", "left_anti")
    done = _folded(_listed(few, "id").join(_known(records), "id"), at_first)
    return done if long is None else done.unionByName(_in_blocks(records, orders.join(long, "id", "left_semi")))


def _in_blocks(records: DataFrame, orders: DataFrame) -> DataFrame:
    """What _replay gives, for records with many orders.

    A block of orders is a function of the few states that a record can be in, so blocks are tried from all of them at once, side by side; a record's walk is then one step
    a block, and a record with a third of all orders is many rows. What a block leaves as it was (reason, into, strength) is marked and taken from before the block.
    """
    was = "="
    blocks = _listed(orders, "id", F.floor(F.col("cmd") / BLOCK).alias("block"))
    same = lambda s, f, p: _given(F.lit(s), F.lit(f), p, F.lit(was), F.lit(-1).cast("long"), F.lit(was), F.size("orders") >= 0)
    starts = F.array(*[same(s, f, F.col("proven")) for s in STATES for f in (False, True)])
    number = lambda state, frozen: (F.array_position(F.array(*map(F.lit, STATES)), state) * 2 + F.when(frozen, 0).otherwise(-1)).cast("int")
    known = _known(records)
    b = blocks.join(known.select("id", "proven"), "id")
    b = b.select("id", "block", F.transform(starts, lambda s: F.aggregate("orders", s, _step)).alias("ends"))
    walk = b.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("block", F.transform("ends", lambda e: F.struct(*[e[n].alias(n) for n in ("state", "frozen", "reason", "into", "strength")])).alias("ends")))).alias("blocks"))
    first = known.select("id", _given(F.col("state"), F.col("frozen"), F.col("proven"), F.col("reason"), F.col("into"), F.col("strength"), F.length("state") >= 0).alias("s"))
    settled = lambda s, e: F.struct(
        e["state"].alias("state"), e["frozen"].alias("frozen"), F.when(e["reason"].eqNullSafe(F.lit(was)), s["reason"]).otherwise(e["reason"]).alias("reason"), F.when(e["into"].eqNullSafe(F.lit(-1).cast("long")), s["into"]).otherwise(e["into"]).alias("into"),
        F.when(e["strength"] == was, s["strength"]).otherwise(e["strength"]).alias("strength"))
    bare = lambda s: F.struct(*[s[n].alias(n) for n in ("state", "frozen", "reason", "into", "strength")])
    ahead = lambda acc, x: F.concat(acc, F.array(settled(F.element_at(acc, -1), F.element_at(x["ends"], number(F.element_at(acc, -1)["state"], F.element_at(acc, -1)["frozen"])))))
    begun = walk.join(first, "id").select("id", "s.proven", F.arrays_zip(F.col("blocks.block").alias("block"), F.aggregate("blocks", F.array(bare(F.col("s"))), ahead).alias("begin")).alias("z"))
    begun = begun.select("id", "proven", F.explode("z").alias("z")).where("z.block is not null").select("id", "proven", F.col("z.block").alias("block"), F.col("z.begin").alias("g"))
    return _folded(blocks.join(begun, ["id", "block"]), [F.col("g.state"), F.col("g.frozen"), F.col("proven"), F.col("g.reason"), F.col("g.into"), F.col("g.strength")])


def _answered(orders: DataFrame, versions: DataFrame | None) -> DataFrame:
    """orders (with into and at_first) with into_active: whether the record that each goes into is active when it comes; versions (into, cmd, state), none at first."""
    if versions is None:
        return orders.withColumn("into_active", F.col("at_first")).drop("at_first")
    now = F.when(F.col("state").isNull(), F.col("at_first")).otherwise(F.col("state") == "active")
    return as_of(orders, versions, "into", "cmd", "state", inclusive=False).withColumn("into_active", now).drop("at_first", "state")


def in_sequence(records: DataFrame, orders: DataFrame) -> DataFrame:
    """What orders (cmd, id, op, why, into) of the owner do one after another, by their numbers cmd (no two alike): refused says why one changes nothing, else the record's next version, and whether a check is queued.

    Park needs an active or candidate record that is not frozen and, where it is absorbed, another record to go into that is active at that time; unpark needs a parked one; the others need only the record.
    Each order meets what all before it have left. Whether the record to go into is active is first taken from the records as given; all is replayed, and looked up again as of each order,
    until no answer changes: each round settles at least the earliest answer that was wrong. Rounds replay the records alone that others go into; the rest is replayed once, when all answers stand. A state that is none of STATES counts as the state other.
    """
    known = records.withColumn("state", F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("other")).withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    rows = orders.join(known.select("id", F.lit(True).alias("known")), "id", "left").select("cmd", "id", "op", "why", "into", "known")
    missing = rows.where("known is null").select("cmd", "id", "op")
    rows = rows.where("known").drop("known")
    long = cut(rows.groupBy("id").count().where(F.col("count") > BLOCK).select("id"))
    long = small(long) if long.limit(1).count() else None
    goes = F.coalesce((F.col("op") == "park") & (F.col("why") == "absorbed") & F.col("into").isNotNull() & (F.col("into") != F.col("id")), F.lit(False))
    ends = small(cut(rows.where(goes).select(F.col("into").alias("id")).distinct()))
    first = known.join(ends, "id").select(F.col("id").alias("into"), (F.col("state") == "active").alias("at_first"))
    met = cut(rows.join(ends, "id", "left_semi"))
    begun = small(cut(first))
    answers = lambda df, versions: _answered(df.where(goes).join(begun, "into"), versions)
    others = lambda df: df.where(~goes).withColumn("into_active", F.lit(None).cast("boolean"))
    asked, plain = cut(answers(met, None)), others(met)
    lost = lambda df: df.where(goes).join(begun, "into", "left_anti").withColumn("into_active", F.lit(None).cast("boolean"))
    nowhere = lost(met)
    while True:
        told = asked.unionByName(plain).unionByName(nowhere)
        versions = cut(_replay(known.join(ends, "id", "left_semi"), told, long).where("refused is null").select(F.col("id").alias("into"), "cmd", "state"))
        new = cut(answers(met, versions))
        if not new.select("cmd", "into_active").join(asked.select("cmd", F.col("into_active").alias("was")), "cmd").where("was <> into_active").limit(1).count():
            break
        asked = new
    done = _replay(known, answers(rows, versions).unionByName(others(rows)).unionByName(lost(rows)), long)
    ok = lambda c: F.when(F.col("refused").isNull(), F.col(c)).alias(c)
    told = done.select("cmd", "id", "op", "refused", ok("state"), ok("reason"), F.when(F.col("refused").isNull(), F.col("into")).alias("absorbed_into"), ok("strength"), ok("frozen"), ok("queued"))
    return told.unionByName(missing.withColumn("refused", F.lit("missing")), allowMissingColumns=True)


def current(bundles: DataFrame, now: DataFrame) -> DataFrame:
    """(target, current): whether the signatures (target, id, signature) of a bundle's target and neighbours are those of now, none more, none less."""
    a, b = bundles.withColumnRenamed("signature", "was"), now.join(bundles.select("target").distinct(), "target", "left_semi")
    same = F.col("was").eqNullSafe(F.col("signature")) & F.col("was").isNotNull()
    return a.join(b, ["target", "id"], "full").groupBy("target").agg(F.bool_and(same).alias("current"))

"""Commits, similar sets and patches against plain versions."""

import json
import random

from claimweave.functions.text_udf import merge_patch
from claimweave.operators import cluster, commit

RECORD = "id long, kind string, state string, reason string, strength string, version long, claim string, frozen boolean, proof long"


def test_merge_patch():
    cases = [('{"a":"b"}', '{"a":null}', {}), ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', {"a": {"b": "d"}}), ('{"a":[1]}', '{"a":{"x":null}}', {"a": {}}), ("[1,2]", '{"a":"b","c":null}', {"a": "b"}), ('{"e":null}', '{"a":1}', {"e": None, "a": 1}), ('{"a":1}', '["c"]', ["c"])]
    for target, patch, want in cases:
        assert json.loads(merge_patch(target, patch)) == want
    assert merge_patch(None, "{}") is None and merge_patch("{}", None) == "{}"


def test_similar_sets(spark):
    rng = random.Random(3)
    rows = [(i, [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))]) for i in range(150)] + [(200, None), (201, [])]
    first = {}
    for i, words in rows:
        if words:
            first.setdefault(frozenset(words), i)
    ids = sorted((i, w) for w, i in first.items())
    want = {(i, j, round(len(a & b) / len(a | b), 3)) for i, a in ids for j, b in ids if i < j and 5 * len(a & b) >= 4 * len(a | b)}
    got = {tuple(r) for r in cluster.similar_sets(spark.createDataFrame(rows, "id long, words array<string>"), 0.8).collect()}
    assert got == want and want


def plain_orders(records, orders):
    """One order after another on a dictionary of records."""
    now = {r[0]: dict(state=r[2], reason=r[3], strength=r[4], frozen=bool(r[7]), proven=r[8] is not None, into=None) for r in records}
    out = {}
    for cmd, i, op, why, into in sorted(orders):
        r, refused = now.get(i), None
        if r is None:
            out[cmd] = ("missing",) + (None,) * 6
            continue
        if op not in ("park", "unpark", "freeze", "unfreeze", "reopen"):
            refused = "order"
        elif op == "park":
            if r["state"] not in ("active", "candidate"):
                refused = "state"
            elif r["frozen"]:
                refused = "frozen"
            elif why not in ("absorbed", "not_needed"):
                refused = "reason"
            elif why == "absorbed" and (into is None or into == i or now.get(into, {}).get("state") != "active"):
                refused = "into"
        elif op == "unpark" and r["state"] != "parked":
            refused = "state"
        if refused:
            out[cmd] = (refused,) + (None,) * 6
            continue
        if op == "park":
            r |= dict(state="parked", reason=why, into=into if why == "absorbed" else None)
        elif op == "unpark":
            r |= dict(state="pending_proof" if r["proven"] else "candidate", reason=None, into=None)
        elif op == "freeze":
            r["frozen"] = True
        else:
            r |= dict(state="pending_proof") | (dict(frozen=False) if op == "unfreeze" else dict(reason=None))
        if op != "freeze":
            r["strength"] = "unassessed"
        out[cmd] = (None, r["state"], r["reason"], r["into"], r["strength"], r["frozen"], op in ("unfreeze", "reopen") or (op == "unpark" and r["proven"]))
    return out


def test_orders_in_sequence(spark, monkeypatch):
    """Orders see what those before them did, on their own record and on the one they go into; one record has a third of all orders, in many blocks."""
    monkeypatch.setattr(commit, "BLOCK", 16)
    rng = random.Random(9)
    states = ["active", "active", "active", "candidate", "parked", "pending_proof", "needs_docs"]
    records = [(i, "node", rng.choice(states), rng.choice([None, "x"]), rng.choice(["strong", "unassessed"]), 1, "c", rng.random() < 0.1, rng.choice([None, None, None, 7])) for i in range(30)]
    orders = []
    for cmd in range(1500):
        i = 3 if rng.random() < 0.33 else rng.randrange(32)
        op = rng.choice(["park", "park", "park", "unpark", "unpark", "unpark", "freeze", "unfreeze", "reopen"] if rng.random() < 0.99 else ["melt", None])
        orders.append((cmd * 3 + 1, i, op, rng.choice(["absorbed", "absorbed", "not_needed", "bored", None]), rng.choice([None, rng.randrange(6), rng.randrange(32)])))
    # a chain: each goes into the next, which has been parked into the one after it just before
    orders += [(9000 + 2 * k, 20 + k, "park", "absorbed", 19 + k) for k in range(1, 8)]
    df = spark.createDataFrame(orders, "cmd long, id long, op string, why string, into long").repartition(5)
    got = {r["cmd"]: (r["refused"], r["state"], r["reason"], r["absorbed_into"], r["strength"], r["frozen"], r["queued"]) for r in commit.in_sequence(spark.createDataFrame(records, RECORD), df).collect()}
    want = plain_orders(records, orders)
    assert got == want and {w[0] for w in want.values()} == {None, "missing", "state", "frozen", "reason", "into", "order"}
    assert commit.in_sequence(spark.createDataFrame(records, RECORD), df.where("false")).count() == 0


def test_few_orders_are_one_list(spark, monkeypatch):
    """Records with few orders are not tried from every state, however far apart the orders' numbers are; one goes into a record that another order has parked."""
    monkeypatch.setattr(commit, "_in_blocks", None)
    records = [(i, "node", "active", None, "strong", 1, "c", False, 7 if i % 2 else None) for i in range(6)]
    orders = [(1000 * k + 1, k % 7, ["park", "unpark", "reopen"][k % 3], ["absorbed", "not_needed"][k % 2], (k * 5) % 8) for k in range(40)]
    got = commit.in_sequence(spark.createDataFrame(records, RECORD), spark.createDataFrame(orders, "cmd long, id long, op string, why string, into long"))
    assert {r["cmd"]: (r["refused"], r["state"], r["reason"], r["absorbed_into"], r["strength"], r["frozen"], r["queued"]) for r in got.collect()} == plain_orders(records, orders)

"""As-of joins and briefs against plain versions."""

import random

import pytest

from claimweave.operators import brief, explore, topics
from claimweave.operators.asof import as_of


@pytest.mark.parametrize("rows", [500_000, 40])
@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of(spark, rows, inclusive):
    """One key has most rows and is cut into ranges; times tie, keys and times are null, values too."""
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    at = lambda: rng.choice([None, *range(60)])
    left = [(n, key(), at(), "own") for n in range(300)]
    right = [(key() or 4, at(), rng.choice([None, "a", "b", "c"])) for _ in range(200)]
    got = as_of(spark.createDataFrame(left, "n int, k int, t int, v string"), spark.createDataFrame(right, "k int, t int, v string"), "k", "t", "v", inclusive, rows)
    assert got.columns == ["n", "k", "t", "v"]
    found = {r["n"]: r["v"] for r in got.collect()}
    for n, k, t, _ in left:
        before = [(u, v is not None, v or "") for c, u, v in right if c == k and u is not None and t is not None and (u <= t if inclusive else u < t)]
        want = max(before)[2] or None if before else None
        assert found[n] == want, (n, k, t)
    assert len(found) == 300


def plain_brief(lines, sections, most):
    room, out, used, dropped = max(most - 64, 80), [], 0, 0
    for section in sections:
        own = [x or "" for _, x in sorted(((q, x or "") for s, q, x in lines if s == section))]
        head = f"\n## {section}"
        if not own:
            continue
        if used + len(head) + 1 > room:
            dropped += len(own)
            continue
        out.append(head)
        used += len(head) + 1
        for i, x in enumerate(own):
            if used + len(x) + 1 > room:
                dropped += len(own) - i
                break
            out.append(x)
            used += len(x) + 1
    if dropped:
        out.append(f"\n[truncated: {dropped} lines over budget]")
    return "\n".join(out).strip() + "\n", used, dropped


def test_brief(spark):
    rng = random.Random(4)
    sections = ["A", "a very long title that takes much of the room", "B", "C"]
    rows = [(k, rng.choice([*sections, "none of them"]), rng.randrange(9), rng.choice([None, "", " ", "x" * rng.randrange(70)])) for k in range(40) for _ in range(rng.randrange(12))]
    rows += [(99, "C", i % 7, "hot " + str(i % 3)) for i in range(3000)] + [(99, "A", 1, "y" * 500), (98, "none of them", 1, "x")]
    for most in (10, 160, 300, 8000):
        got = {r["k"]: (r["body"], r["used"], r["dropped"]) for r in brief.render(spark.createDataFrame(rows, "k int, s string, q int, x string"), "k", "s", "q", "x", sections, most).collect()}
        for k in {r[0] for r in rows}:
            own = [r[1:] for r in rows if r[0] == k and r[1] in sections]
            assert got.get(k) == (plain_brief(own, sections, most) if own else None), (most, k)


def plain_explore(threads, terminal, budget, most, limit):
    """One call after another, as the rounds go."""
    state = {t: {"status": None, "rounds": 0, "stale": 0, "done": False, "out": False} for t in sorted(threads)}
    for r in range(1, most + 1):
        for t in [t for t in state if not state[t]["done"] and len(threads[t]) >= r]:
            s = state[t]
            s["rounds"] = r
            if budget <= 0:
                s |= {"status": "not_covered", "done": True, "out": True}
                continue
            budget -= 1
            before, s["status"] = s["status"], threads[t][r - 1]
            s["stale"] = s["stale"] + 1 if before == s["status"] else 0
            s["done"] = s["status"] in terminal or s["stale"] >= limit
    return {t: (s["rounds"], s["status"], s["out"]) for t, s in state.items() if s["rounds"]}


def test_explored(spark):
    rng = random.Random(7)
    threads = {f"t{i}": [rng.choice(["open", "open", "attributed", "verified"]) for _ in range(rng.randrange(9))] for i in range(60)}
    rows = spark.createDataFrame([(t, k, s) for t, own in threads.items() for k, s in enumerate(own)], "thread string, seq int, status string").repartition(5)
    for budget, most, limit in ((0, 5, 2), (37, 5, 2), (90, 5, 1), (140, 7, 3), (10_000, 5, 2)):
        got = {r["thread"]: (r["rounds"], r["status"], r["exhausted"]) for r in explore.explored(rows, ("verified",), budget, most, limit).collect()}
        assert got == plain_explore(threads, ("verified",), budget, most, limit), budget


def test_topic_files(spark):
    files = [
        (1, "before\n# Topic\nOne thing\nmore of it\n## SCOPE\n- Period: 1990-2000\n* Region : EU\n1. third\nstray\n\n### unknown\n- x\n## Exclusions\n   \n## topic\nagain"), (2, ""), (3, None), (4, "#no heading\n#  Seed Claims  \r\n2) a\r\n  - b "), (5, "## paper type"), (6, "Topic\n- a"),
    ]
    df = spark.createDataFrame(files, "f int, t string")
    found = topics.parsed(df, "f", "t")
    got = {(r["f"], r["section"]): (r["items"], r["stray"], r["empty"], r["repeated"]) for r in found.collect()}
    assert got == {
        (1, "topic"): (["One thing\nmore of it"], 0, False, True), (1, "scope"): (["Period: 1990-2000", "Region : EU", "third"], 1, False, False), (1, "exclusions"): ([], 0, True, False),
        (4, "seed claims"): (["a", "b"], 0, False, False), (5, "paper type"): ([], 0, True, False),
    }
    lacks = {r["f"]: r["missing"] for r in topics.missing(df, found, "f").collect()}
    assert lacks[2] == lacks[3] == topics.SECTIONS and lacks[1] == [s for s in topics.SECTIONS if s not in ("topic", "scope", "exclusions")]

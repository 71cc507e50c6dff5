"""The status function against an independent model in plain Python, and the lattice's laws."""

from itertools import product

from claimweave.operators.status import with_status
from claimweave.plans.status_plans import lines, vectors
from tests.support import SF

RANK = {"verified": 3, "attributed": 2, "estimated": 2, "unverified": 1}


def meet(x, y):
    if "not_covered" in (x, y):
        return "not_covered"
    if "contested" in (x, y):
        return "contested"
    if x == y:
        return x
    if RANK[x] == RANK[y]:
        return "unverified"
    return min(x, y, key=RANK.get)


def down(x):
    return {"verified": "attributed", "attributed": "unverified", "estimated": "unverified"}.get(x, x)


def model(r):
    """(status, step) by walking the rules in order."""
    need = ["kind", "source_integrity", "evidence_grade", "independent_cluster_count", "counter_evidence_searched", "counter_evidence_found", "mechanism_results", "flags", "budget_state", "retention_tier"]
    if any(r[k] is None for k in need):
        return "not_covered", "0-required"
    if r["quote_faithful"] not in (None, "pass", "fail", "na") or r["budget_state"] not in ("ok", "degraded", "exhausted"):
        return "not_covered", "0-domain"
    si, kind, flags = r["source_integrity"], r["kind"], r["flags"]
    early = {"mutated": ("unverified", "0a"), "missing": ("unverified", "0a"), "contaminated": ("contested", "0b"), "not_covered": ("not_covered", "0c")}
    if si in early:
        return early[si]
    if si not in ("intact", "na") or si == "na" and kind != "K-I":
        return None, "0-integrity"
    # beyond this point the source is intact, so flags that say otherwise are undriven
    wrong = {"F-05", "F-06", "F-07", "F-16", "F-27", "F-18", "F-21", "F-30", "F-32", "F-33"} & set(flags)
    checks = {
        "F-28": r["has_verbatim_quote"] is True and r["quote_faithful"] == "fail", "F-29": r["counter_evidence_searched"] is False, "F-11": r["budget_state"] != "ok", "F-31": r["counter_evidence_found"], "F-10": r["chart_extracted"] is True,
        "F-14": r["independent_cluster_count"] == 1, "F-34": r["retention_tier"] == "C", "F-28a": "F-28" in flags,
    }
    if wrong or any(f in flags and not ok for f, ok in checks.items()):
        return "not_covered", "0-flag-driver"
    if ("F-10" in flags) != (r["chart_extracted"] is True):
        return "not_covered", "0-domain"
    if checks["F-28"]:
        return "unverified", "0d"
    if not r["counter_evidence_searched"]:
        return "not_covered", "0e"
    if r["budget_state"] == "exhausted":
        return "not_covered", "0f"
    if not r["mechanism_results"]:
        return "not_covered", "0g"
    support = "attributed" if r["attribution_verdict"] == "support" else "unverified"
    clusters = {"K-D": 1, "K-L-T": 1, "K-L-A": 2, "K-I": 2}
    if kind == "K-D":
        if r["question_frozen"] is None:
            return None, "1-K-D"
        base = ("verified" if r["question_frozen"] else "attributed") if r["rerun_gate_passed"] else "unverified"
    elif kind == "K-L-T":
        if r["polarity_scope_passed"] is None or r["frame_gate_passed"] is None:
            return None, "1-K-L-T"
        if r["anchor_containment_passed"] and r["polarity_scope_passed"] and r["frame_gate_passed"]:
            base = "verified"
        else:
            kind, base = "K-L-A", support
    elif kind == "K-L-A":
        base = support
    elif kind == "K-I":
        base = "attributed" if r["inference_gate_passed"] else "unverified"
    else:
        return None, "1-kind"
    if "GC-2" in r["mechanism_results"]:
        base = meet(base, "attributed")
    if r["chart_extracted"]:
        base = "estimated"
    if r["counter_evidence_found"]:
        return "contested", "2a"
    grade = {"G5": "verified", "G4": "attributed", "G3": "attributed", "G2": "attributed", "G1": "not_covered", "G0": "not_covered"}.get(r["evidence_grade"])
    tier = {"A": "verified", "B": "verified", "C": "attributed"}.get(r["retention_tier"])
    if grade is None or tier is None:
        return None, "2c"
    if r["independent_cluster_count"] < clusters[kind]:
        base = down(base)
    base = meet(meet(base, grade), tier)
    for f in flags:
        base = meet(base, {"F-13": "unverified", "F-12": "unverified", "F-03": "attributed", "F-04": "attributed"}.get(f, "verified")) if f in ("F-13", "F-12", "F-03", "F-04") else base
    for f in flags:
        if f in ("F-01", "F-02", "F-09", "F-15", "F-24", "F-25"):
            base = down(base)
    return down(base) if r["budget_state"] == "degraded" else base, "end"


def test_vectors_match_the_model(spark):
    got = with_status(vectors(lines(spark, SF))).collect()
    wrong = [(r["id"], (r["status"], r["step"]), model(r.asDict())) for r in got if (r["status"], r["step"]) != model(r.asDict())]
    assert not wrong, wrong[:3]
    assert len({r["status"] for r in got}) == 7 and len({r["step"] for r in got}) > 14


def test_meet_is_a_meet():
    values = [*RANK, "not_covered", "contested"]
    for x, y, z in product(values, repeat=3):
        assert meet(x, y) == meet(y, x)
        assert meet(meet(x, y), z) == meet(x, meet(y, z))


def test_generated_code_stays_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for given, want in ((65535, "8000"), (4000, "4000")):
            spark.conf.set(key, str(given))
            with_status(vectors(lines(spark, SF)))
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)

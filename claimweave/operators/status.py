"""The status function: from a claim's record to its status and the steps that led there.

Total by construction: what the rules leave undefined (a kind outside the enumeration, a missing conjunct) gives a
null status and says where in contract_gap. The order of the steps is part of the meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.lattice import A, C, E, N, U, V, meet, step_down, steps_down

# fixed values of the status rules
REQUIRED = ["evidence_grade", "independent_cluster_count", "counter_evidence_searched", "counter_evidence_found", "mechanism_results", "flags", "budget_state", "source_integrity", "kind", "retention_tier"]
CLUSTERS_NEEDED = {"K-D": 1, "K-L-T": 1, "K-L-A": 2, "K-I": 2}
GRADE_CEILING = {"G5": V, "G4": A, "G3": A, "G2": A, "G1": N, "G0": N}
TIER_CEILING = {"A": V, "B": V, "C": A}
FLAG_CEILING = {"F-13": U, "F-12": U, "F-03": A, "F-04": A}
#: Bytes of a method beyond which the JVM leaves it to its interpreter.
COMPILED = 8000
FLAG_STEP_DOWN = ["F-01", "F-02", "F-09", "F-15", "F-24", "F-25"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def flag_drivers() -> dict[str, Column]:
    """Under what condition each flag may be set."""
    integrity = lambda *v: F.col("source_integrity").isin(*v)
    lost, uncovered, tainted = integrity("mutated", "missing"), integrity("not_covered"), integrity("contaminated")
    return {
        **dict.fromkeys(("F-05", "F-06", "F-07"), tainted), **dict.fromkeys(("F-16", "F-27"), lost),
        **dict.fromkeys(("F-18", "F-21", "F-30", "F-32", "F-33"), uncovered),
        "F-28": yes("has_verbatim_quote") & F.col("quote_faithful").eqNullSafe("fail"), "F-29": ~F.col("counter_evidence_searched"),
        "F-11": F.col("budget_state").isin("exhausted", "degraded"), "F-31": F.col("counter_evidence_found"), "F-10": yes("chart_extracted"),
        "F-14": F.col("independent_cluster_count") == 1, "F-34": F.col("retention_tier") == "C", "F-28a": F.array_contains("flags", "F-28"),
    }


def with_status(claims: DataFrame) -> DataFrame:
    """claims with status, step (where it was decided), trace (codes of the steps that acted) and contract_gap.

    The session's limit for generated methods becomes COMPILED at most, as this expression fused with others is one method that the JVM would interpret for every row.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(claims.sparkSession.conf.get(key)) > COMPILED:
        claims.sparkSession.conf.set(key, str(COMPILED))
    has = lambda f: F.array_contains("flags", f)
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in REQUIRED])
    undriven = F.lit(False)
    for flag, driver in flag_drivers().items():
        undriven = undriven | (has(flag) & ~F.coalesce(driver, F.lit(False)))
    integrity, kind = F.col("source_integrity"), F.col("kind")
    bad_domain = (F.col("quote_faithful").isNotNull() & ~F.col("quote_faithful").isin("pass", "fail", "na")) | ~F.col("budget_state").isin("ok", "degraded", "exhausted")
    early = (
        F.when(missing, F.struct(F.lit("0-required").alias("step"), F.lit(N).alias("status")))
        .when(bad_domain, stop("0-domain", N)).when(integrity.isin("mutated", "missing"), stop("0a", U))
        .when(integrity == "contaminated", stop("0b", C)).when(integrity == "not_covered", stop("0c", N))
        .when((integrity == "na") & (kind != "K-I"), gap("0-integrity")).when(~integrity.isin("intact", "na"), gap("0-integrity"))
        .when(undriven, stop("0-flag-driver", N)).when(has("F-10") != yes("chart_extracted"), stop("0-domain", N))
        .when(yes("has_verbatim_quote") & F.col("quote_faithful").eqNullSafe("fail"), stop("0d", U))
        .when(~F.col("counter_evidence_searched"), stop("0e", N)).when(F.col("budget_state") == "exhausted", stop("0f", N))
        .when(F.size("mechanism_results") == 0, stop("0g", N))
        .when((kind == "K-D") & F.col("question_frozen").isNull(), gap("1-K-D"))
        .when((kind == "K-L-T") & (F.col("polarity_scope_passed").isNull() | F.col("frame_gate_passed").isNull()), gap("1-K-L-T"))
        .when(~kind.isin(*CLUSTERS_NEEDED), gap("1-kind"))
        .when(F.col("counter_evidence_found"), stop("2a", C))
        .when(literal_map(GRADE_CEILING)[F.col("evidence_grade")].isNull() | literal_map(TIER_CEILING)[F.col("retention_tier")].isNull(), gap("2c"))
    )
    supported = F.when(F.col("attribution_verdict").eqNullSafe("support"), A).otherwise(U)
    transcribed = yes("anchor_containment_passed") & yes("polarity_scope_passed") & yes("frame_gate_passed")
    by_kind = (
        F.when(kind == "K-D", F.when(yes("rerun_gate_passed"), F.when(yes("question_frozen"), V).otherwise(A)).otherwise(U))
        .when(kind == "K-L-T", F.when(transcribed, V).otherwise(supported)).when(kind == "K-L-A", supported)
        .otherwise(F.when(yes("inference_gate_passed"), A).otherwise(U))
    )
    weak = F.array_contains("mechanism_results", "GC-2")
    df = claims.withColumn("_early", early).withColumn("_kind", F.when((kind == "K-L-T") & ~transcribed, "K-L-A").otherwise(kind))
    df = df.withColumn("_b1", by_kind).withColumn("_b1", F.when(yes("chart_extracted"), F.lit(E)).otherwise(F.when(weak, meet(F.col("_b1"), F.lit(A))).otherwise(F.col("_b1"))))
    few = F.col("independent_cluster_count") < literal_map(CLUSTERS_NEEDED)[F.col("_kind")]
    df = df.withColumn("_b2", F.when(few, step_down(F.col("_b1"))).otherwise(F.col("_b1")))
    df = df.withColumn("_b3", meet(meet(F.col("_b2"), literal_map(GRADE_CEILING)[F.col("evidence_grade")]), literal_map(TIER_CEILING)[F.col("retention_tier")]))
    df = df.withColumn("_b4", F.col("_b3"))
    for ceiling in dict.fromkeys(FLAG_CEILING.values()):
        bound = F.arrays_overlap("flags", F.array(*[F.lit(f) for f, c in FLAG_CEILING.items() if c == ceiling]))
        df = df.withColumn("_b4", F.when(bound, meet(F.col("_b4"), F.lit(ceiling))).otherwise(F.col("_b4")))
    # what is removed counts, so that a flag set twice steps down twice; functions of lambdas would leave generated code
    df = df.withColumn("_downs", F.size("flags") - F.size(reduce(F.array_remove, FLAG_STEP_DOWN, F.col("flags"))))
    df = df.withColumn("_b5", steps_down(F.col("_b4"), F.col("_downs")))
    degraded = F.col("budget_state") == "degraded"
    df = df.withColumn("_b6", F.when(degraded, step_down(F.col("_b5"))).otherwise(F.col("_b5")))
    ceiled = F.arrays_overlap("flags", F.array(*map(F.lit, FLAG_CEILING)))
    acted = [("1", F.lit(True)), ("1-K-L-A", F.col("_kind") != kind), ("1-GC-2", weak), ("1-chart", yes("chart_extracted")), ("2b", few), ("2c", F.lit(True)), ("2d", ceiled), ("2d'", F.col("_downs") > 0), ("2e", degraded)]
    late = F.array_remove(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)).otherwise("") for code, c in acted]), "")
    decided = F.col("_early").isNotNull()
    out = df.select(
        *[F.col(c) for c in claims.columns], F.when(decided, F.col("_early.status")).otherwise(F.col("_b6")).alias("status"), F.when(decided, F.col("_early.step")).otherwise("end").alias("step"),
        F.when(decided, F.array(F.col("_early.step"))).otherwise(late).alias("trace"))
    return out.withColumn("contract_gap", F.when(F.col("status").isNull(), F.col("step")))


def stop(step: str, status: str) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"))


def gap(step: str) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(None).cast("string").alias("status"))

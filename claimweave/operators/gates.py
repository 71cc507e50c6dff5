"""Gates and decision tables as column expressions over the fields that their docstrings name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.lattice import worst

INTEGRITY_RANK = {"intact": 0, "not_covered": 1, "missing": 2, "mutated": 3}
MAX_ROUND = 2


def with_verdict(forms: DataFrame) -> DataFrame:
    """The first of eight rows that applies to a check form: verdict, repair_kind, strength, reason, row."""
    edge = F.col("is_edge")
    row = (
        F.when(F.col("scope_check") == "out_of_scope", 1).when(F.col("duplicate"), 2).when(F.col("wellformed_check").isin("too_broad", "compound"), 3)
        .when(F.col("evidence_check") == "contradicting", 4).when(F.col("evidence_check") == "insufficient", 5)
        .when(edge & (F.col("inference_check") == "fails"), 6).when(edge & (F.col("inference_check") == "gap"), 7).otherwise(8)
    )
    r = F.col("row")
    return (
        forms.withColumn("row", row)
        .withColumn("verdict", F.when(r == 8, "pass").when(r == 5, "needs_docs").when(r.isin(3, 7), "needs_repair").otherwise("rejected"))
        .withColumn("repair_kind", F.when(r == 3, "narrow").when(r == 7, "bridge"))
        .withColumn("strength", F.when(r == 8, F.when(F.col("n_assumptions") > 0, "conditional").otherwise("strong")))
        .withColumn("reason", F.when(r == 1, "out_of_scope").when(r == 2, "duplicate").when(r.isin(4, 6), "contradicted"))
    )


def ladder_violations(forms: DataFrame) -> DataFrame:
    """Which shape rules a form's attachments break, given the row that decides it."""
    r = F.col("row")
    rules = [
        ("V-PR-04", F.col("inference_check").isNotNull() != F.col("is_edge")), ("V-PR-05", r.isin(1, 2, 3) & (F.col("n_evidence") > 0)), ("V-PR-07", (r == 5) & (F.col("n_requests") == 0)),
        ("V-PR-07", r.isin(4, 8) & (F.col("n_evidence") == 0)), ("V-PR-07", (r == 7) & ~F.col("n_bridges").between(1, 2)), ("V-PR-09", (r != 7) & (F.col("n_bridges") > 0)),
    ]
    return with_verdict(forms).withColumn("violations", broken(rules))


def ladder_shape() -> list[tuple[str, Column]]:
    """The rules that a form's shape breaks. The ladder asks for scope and duplicates, then form, evidence and, of an edge, inference; whatever it reaches must be answered, all else not_evaluated."""
    none, evidence, inference, edge = F.lit("not_evaluated"), F.col("evidence_check"), F.col("inference_check"), F.col("is_edge")
    form = (F.col("scope_check") == "in_scope") & ~F.col("duplicate")
    proof = form & (F.col("wellformed_check") == "single_proposition")
    step = proof & evidence.isin("not_required", "sufficient")
    unlike = (form == (F.col("wellformed_check") == none)) | (proof == (evidence == none)) | (edge & (step == (inference == none)))
    assumed = F.col("n_assumptions") > 0
    loose = F.when(edge, (inference == "holds_only_with_assumptions") != assumed).otherwise(assumed & ~evidence.isin("not_required", "sufficient"))
    return [("V-PR-05", proof & ~edge & F.col("node_type").isin("fact", "mechanism") & (evidence == "not_required")), ("V-PR-14", unlike), ("V-PR-15", loose)]


def broken(rules: list[tuple[str, Column]]) -> Column:
    """The ids of the rules whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]), lambda x: x.isNotNull())


def wave_verdict(waves: DataFrame) -> DataFrame:
    enough = F.col("productive") >= F.col("mandatory")
    more = ~enough & (F.col("round") < MAX_ROUND) & (F.col("specs") > 0)
    return waves.withColumn("verdict", F.when(enough, "sufficient").when(more, "followup").otherwise("closed")).withColumn("next_round", F.when(more, F.col("round") + 1))


def triangulated() -> Column:
    """t12: bindings of the two best tiers; docs; t34_docs and t34_publishers (non-empty) of the next two."""
    return ((F.col("t12") > 0) & (F.col("docs") >= 2)) | ((F.col("t34_docs") >= 2) & (F.col("t34_publishers") >= 2))


def role_floor() -> Column:
    spine = (F.col("bindings") >= 2) & triangulated() & (F.col("counter") > 0)
    return (
        F.when(F.col("role") == "none", F.lit(True)).when(F.col("role") == "nonspine", F.col("bindings") >= 1)
        .when(F.col("role") == "bridge", spine & (F.col("docs") >= 3)).otherwise(spine & (F.col("docs") >= 2))
    )


def saturated() -> Column:
    """Two rounds, every mandatory angle attempted, nothing new in the last; markets also need the industry angle."""
    tried = (F.col("official") > 0) & (F.col("academic") > 0) & (F.col("counter") > 0) & (~F.col("market") | (F.col("industry") > 0))
    return (F.col("rounds") >= 2) & tried & (F.col("new_docs_last") == 0)


def grade() -> Column:
    kind = F.col("content_kind")
    located = F.coalesce(F.length("locator"), F.lit(0)) > 0
    return (
        F.when(~F.col("has_body"), "G0").when(~F.col("quote_in_body"), "G1").when(kind == "metadata", "G2").when(kind.isNull() | (kind != "fulltext"), "G3")
        .when(~located, "G4").when(F.coalesce("roundtrip_verified", F.lit(False)), "G5").otherwise("G4")
    )


def attribution() -> Column:
    return F.when(F.col("polarity").eqNullSafe(False), "contradict").when((F.col("quote") != "pass") | ~F.col("payload_in_quote"), "unclear").otherwise("support")


def integrity() -> Column:
    return F.when(~F.col("card"), "not_covered").when(~F.col("blob"), "missing").when(~F.col("hash_ok") | ~F.col("quote_in_body"), "mutated").otherwise("intact")


def worst_of(evidence: DataFrame, key: str) -> DataFrame:
    """A claim's grade, tier and integrity: the worst of its evidence; an undeclared tier is C."""
    rows = evidence.groupBy(key).agg(F.min("grade").alias("grade"), F.max(F.coalesce("tier", F.lit("C"))).alias("tier"), F.collect_set("integrity").alias("all"))
    return rows.select(key, "grade", "tier", worst(INTEGRITY_RANK, F.col("all"), "not_covered").alias("integrity"))


def freeze() -> Column:
    """A frozen record exists, its hash is the question's, and no retrieval is older (ISO strings compare as times)."""
    late = F.forall("retrieved_at", lambda t: t.isNotNull() & (t >= F.col("frozen_at")))
    return F.coalesce(F.col("frozen_at").isNotNull() & (F.col("frozen_hash") == F.col("question_hash")) & late, F.lit(False))


def inference(claims: DataFrame, premises: DataFrame, decided: DataFrame) -> DataFrame:
    """Premises exist, are not the claim itself, and all are decided as verified or attributed."""
    good = F.coalesce(F.col("status").isin("verified", "attributed"), F.lit(False))
    own = premises.join(decided, "premise", "left").groupBy("claim").agg(F.count("premise").alias("n"), F.bool_and(good).alias("ok"))
    return claims.join(own, "claim", "left").select("claim", F.coalesce("n", F.lit(0)).alias("n_premises"), F.coalesce("ok", F.lit(False)).alias("passed"))


def rerun(runs: DataFrame, declared: str) -> DataFrame:
    """Recorded runs of a claim's script: at least two, one digest, the declared one."""
    own = runs.groupBy("claim").agg(F.countDistinct("digest").alias("n_digests"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("d"))
    return own.select("claim", "n_digests", ((F.col("n") >= 2) & (F.col("n_digests") == 1) & (F.col("d") == declared)).alias("passed"))

"""Queries about statuses, the lattice, decision tables and gates, bound to the lines of orders: every field of a record goes by one of its line's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import gates
from claimweave.operators.lattice import meet, step_down
from claimweave.operators.rules import violations
from claimweave.operators.status import with_status
from claimweave.plans.registry import query
from claimweave.sources.tables import load

#: A record a line, and what its fields go by, as whole numbers.
LINES = "select l_orderkey * 8 + l_linenumber as id, l_orderkey as ord, l_partkey as part, l_suppkey as supplier, cast(floor(l_quantity) as bigint) as quantity, cast(floor(l_extendedprice) as bigint) as price, cast(year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate) as bigint) as days from lineitem"
KEYS = ("price", "part", "days", "price + quantity", "part + supplier", "days + quantity", "price + part", "price + days")


def pick(i: int, values: list[str | None], keys: tuple[str, ...] = KEYS) -> str:
    """SQL that both engines read: a value by the column that the field goes by, mixed by the field's number."""
    n = f"((({keys[i % len(keys)]}) * {(2654435, 7919, 104729, 1299709, 15485863, 611953)[i % 6]} + {i * 977 + 13}) % 1000003) % {len(values)}"
    return f"case {n} " + " ".join(f"when {k} then {'null' if v is None else v}" for k, v in enumerate(values)) + " end"


def fields(names: dict[str, list], offset: int = 0) -> list[str]:
    return [f"{pick(i + offset, v)} as {name}" for i, (name, v) in enumerate(names.items())]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(LINES)


def q(*values: str | None, often: int = 1) -> list[str | None]:
    """Quoted values, the first of them several times."""
    return [None if v is None else f"'{v}'" for v in (*values[:1] * often, *values)]


TRI = ["true", "true", "true", "false", None]
FLAG_SETS = ["", "", "", "F-01", "F-02,F-09", "F-03", "F-13", "F-12,F-01", "F-10", "F-14", "F-34", "F-29", "F-04,F-15,F-24", "F-05", "F-11", "F-31", "F-28", "F-28a", "F-16", "F-25"]
VECTOR = {
    "kind": q("K-D", "K-L-T", "K-L-A", "K-I", "K-L-T", "K-D", "K-X", None), "source_integrity": q("intact", "mutated", "missing", "contaminated", "not_covered", "na", "odd", None, often=14),
    "evidence_grade": q("G5", "G4", "G3", "G2", "G1", "G0", "G9", None, often=6), "independent_cluster_count": ["2", "1", "0", "3", "2", "2", None],
    "counter_evidence_searched": ["true"] * 9 + ["false", None], "counter_evidence_found": ["false"] * 9 + ["true", None], "mechanisms": q("GC-1", "GC-2", "GC-1,GC-2", "", None, often=5),
    "flag_list": [f"'{f}'" for f in FLAG_SETS] + [None], "budget_state": q("ok", "degraded", "exhausted", "odd", None, often=7), "retention_tier": q("A", "B", "C", "D", None, often=5),
    "question_frozen": TRI, "rerun_gate_passed": TRI, "anchor_containment_passed": TRI, "polarity_scope_passed": TRI, "frame_gate_passed": TRI, "inference_gate_passed": TRI,
    "chart_extracted": ["false"] * 8 + ["true", None], "has_verbatim_quote": TRI, "quote_faithful": q("pass", "na", "fail", "odd", None, often=6), "attribution_verdict": q("support", "contradict", "unclear", None, often=3),
}
VECTOR_SQL = ", ".join(fields(VECTOR))


def vectors(base: DataFrame) -> DataFrame:
    """base: rows like those of LINES."""
    df = base.selectExpr("id", *fields(VECTOR))
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return df.withColumn("flags", listed("flag_list")).withColumn("mechanism_results", listed("mechanisms"))


# the rules once more, as nested CASE over ranks
_S = f"""
with v as (select id, {VECTOR_SQL} from ({LINES})),
w as (select *, ',' || flag_list || ',' as f, chart_extracted is not distinct from true as chart, has_verbatim_quote is not distinct from true and quote_faithful is not distinct from 'fail' as misquoted,
  kind = 'K-L-T' and not (coalesce(anchor_containment_passed, false) and coalesce(polarity_scope_passed, false) and coalesce(frame_gate_passed, false)) as fell,
  kind is null or source_integrity is null or evidence_grade is null or independent_cluster_count is null or counter_evidence_searched is null or counter_evidence_found is null or mechanisms is null or flag_list is null or budget_state is null or retention_tier is null as missing from v),
d as (select *, (regexp_matches(f, ',(F-05|F-06|F-07),') and source_integrity <> 'contaminated') or (regexp_matches(f, ',(F-16|F-27),') and source_integrity not in ('mutated', 'missing'))
  or (regexp_matches(f, ',(F-18|F-21|F-30|F-32|F-33),') and source_integrity <> 'not_covered') or (f like '%,F-28,%' and not misquoted) or (f like '%,F-29,%' and counter_evidence_searched)
  or (f like '%,F-11,%' and budget_state not in ('exhausted', 'degraded')) or (f like '%,F-31,%' and not counter_evidence_found) or (f like '%,F-10,%' and not chart)
  or (f like '%,F-14,%' and independent_cluster_count <> 1) or (f like '%,F-34,%' and retention_tier <> 'C') or (f like '%,F-28a,%' and f not like '%,F-28,%') as undriven from w),
e as (select *, case when missing then '0-required' when quote_faithful not in ('pass', 'fail', 'na') or budget_state not in ('ok', 'degraded', 'exhausted') then '0-domain'
  when source_integrity in ('mutated', 'missing') then '0a' when source_integrity = 'contaminated' then '0b' when source_integrity = 'not_covered' then '0c'
  when source_integrity = 'na' and kind <> 'K-I' or source_integrity not in ('intact', 'na') then '0-integrity' when undriven then '0-flag-driver' when (f like '%,F-10,%') <> chart then '0-domain'
  when misquoted then '0d' when not counter_evidence_searched then '0e' when budget_state = 'exhausted' then '0f' when mechanisms = '' then '0g'
  when kind = 'K-D' and question_frozen is null then '1-K-D' when kind = 'K-L-T' and (polarity_scope_passed is null or frame_gate_passed is null) then '1-K-L-T'
  when kind not in ('K-D', 'K-L-T', 'K-L-A', 'K-I') then '1-kind' when counter_evidence_found then '2a' when evidence_grade not in ('G0', 'G1', 'G2', 'G3', 'G4', 'G5') or retention_tier not in ('A', 'B', 'C') then '2c' else 'end' end as step,
  case when chart then 'E' when kind = 'K-D' then case when coalesce(rerun_gate_passed, false) then case when question_frozen then 'V' else 'A' end else 'U' end
   when kind = 'K-L-T' and not fell then 'V' when kind = 'K-I' then case when coalesce(inference_gate_passed, false) then 'A' else 'U' end when attribution_verdict is not distinct from 'support' then 'A' else 'U' end as s0 from d),
g as (select *, case when not chart and mechanisms like '%GC-2%' and s0 = 'V' then 'A' else s0 end as s1, independent_cluster_count < case when kind = 'K-D' or kind = 'K-L-T' and not fell then 1 else 2 end as few from e),
h as (select *, case when few then case s1 when 'V' then 'A' else 'U' end else s1 end as s2 from g),
i as (select *, case when evidence_grade in ('G0', 'G1') then 'N' when s2 = 'V' and (evidence_grade <> 'G5' or retention_tier = 'C') then 'A' when s2 = 'E' and (evidence_grade <> 'G5' or retention_tier = 'C') then 'U' else s2 end as s3 from h),
j as (select *, case when s3 = 'N' then 'N' when regexp_matches(f, ',(F-13|F-12),') then 'U' when regexp_matches(f, ',(F-03|F-04),') then case s3 when 'V' then 'A' when 'E' then 'U' else s3 end else s3 end as s4,
  len(regexp_extract_all(flag_list, 'F-(01|02|09|15|24|25)')) + case when budget_state = 'degraded' then 1 else 0 end as downs from i),
k as (select *, case when s4 = 'N' or downs = 0 then s4 when downs = 1 and s4 = 'V' then 'A' else 'U' end as s5 from j)
"""
_STATUS = "case when step in ('0-required', '0-domain', '0c', '0-flag-driver', '0e', '0f', '0g') then 'not_covered' when step in ('0a', '0d') then 'unverified' when step in ('0b', '2a') then 'contested' when step = 'end' then case s5 when 'V' then 'verified' when 'A' then 'attributed' when 'E' then 'estimated' when 'U' then 'unverified' else 'not_covered' end end"


@query(_S + f"select id, {_STATUS} as status, step, case when {_STATUS} is null then step end as contract_gap from k")
def status_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(vectors(lines(spark, sf_dir))).select("id", "status", "step", "contract_gap")


@query(_S + """select id, case when step <> 'end' then step else '1' || case when fell then '|1-K-L-A' else '' end || case when mechanisms like '%GC-2%' then '|1-GC-2' else '' end || case when chart then '|1-chart' else '' end
 || case when few then '|2b' else '' end || '|2c' || case when regexp_matches(f, ',(F-13|F-12|F-03|F-04),') then '|2d' else '' end || case when regexp_matches(flag_list, 'F-(01|02|09|15|24|25)') then '|2d''' else '' end || case when budget_state = 'degraded' then '|2e' else '' end end as trace from k""")
def status_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(vectors(lines(spark, sf_dir))).select("id", F.array_join("trace", "|").alias("trace"))


@query(_S + f"select {_STATUS} as status, step, cast(count(*) as bigint) as n from k group by 1, 2")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(vectors(lines(spark, sf_dir))).groupBy("status", "step").agg(F.count(F.lit(1)).alias("n"))


STATUSES = ["verified", "attributed", "estimated", "unverified", "not_covered", "contested"]
PAIR = {"x": q(*STATUSES)[1:], "y": q(*STATUSES)[1:]}
_PAIRS = f"(select id, {', '.join(fields(PAIR, 34))} from ({LINES}))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("id", *fields(PAIR, 34))


@query(f"""select id, x, y, case when 'not_covered' in (x, y) then 'not_covered' when 'contested' in (x, y) then 'contested' when x = y then x
 when x = 'verified' then y when y = 'verified' then x else 'unverified' end as m from {_PAIRS}""")
def lattice_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("m", meet(F.col("x"), F.col("y")))


@query(f"select id, x, case x when 'verified' then 'attributed' when 'contested' then x when 'not_covered' then x else 'unverified' end as down from {_PAIRS}")
def lattice_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("id", "x", step_down(F.col("x")).alias("down"))


FORM = {
    "scope_check": q("in_scope", "out_of_scope", often=6), "duplicate": ["false"] * 5 + ["true"], "wellformed_check": q("ok", "too_broad", "compound", often=5), "evidence_check": q("sufficient", "insufficient", "contradicting", often=4),
    "inference_check": q("holds", "gap", "fails", None, often=2), "is_edge": ["true", "false"], "n_assumptions": ["0", "1", "0", "2"], "n_evidence": ["1", "0", "2", "1"], "n_requests": ["0", "1", "0"], "n_bridges": ["0", "1", "0", "3"],
}
FORM_SQL = ", ".join(fields(FORM, 40))
_FORMS = f"with f as (select id, {FORM_SQL} from ({LINES}))"


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("id", *fields(FORM, 40))


_ROW = "case when scope_check = 'out_of_scope' then 1 when duplicate then 2 when wellformed_check in ('too_broad', 'compound') then 3 when evidence_check = 'contradicting' then 4 when evidence_check = 'insufficient' then 5 when is_edge and inference_check = 'fails' then 6 when is_edge and inference_check = 'gap' then 7 else 8 end"


@query(_FORMS + f""" select id, case r when 5 then 'needs_docs' when 8 then 'pass' when 3 then 'needs_repair' when 7 then 'needs_repair' else 'rejected' end as verdict, case r when 3 then 'narrow' when 7 then 'bridge' end as repair_kind,
 case when r = 8 then case when n_assumptions > 0 then 'conditional' else 'strong' end end as strength, case r when 1 then 'out_of_scope' when 2 then 'duplicate' when 4 then 'contradicted' when 6 then 'contradicted' end as reason from (select *, {_ROW} as r from f)""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.with_verdict(forms(spark, sf_dir)).select("id", "verdict", "repair_kind", "strength", "reason")


@query(_FORMS + f""" select id, array_to_string(list_filter([case when (inference_check is not null) <> is_edge then 'V-PR-04' end, case when r in (1, 2, 3) and n_evidence > 0 then 'V-PR-05' end,
 case when r = 5 and n_requests = 0 then 'V-PR-07' end, case when r in (4, 8) and n_evidence = 0 then 'V-PR-07' end, case when r = 7 and (n_bridges < 1 or n_bridges > 2) then 'V-PR-07' end, case when r <> 7 and n_bridges > 0 then 'V-PR-09' end], lambda x: x is not null), ',') as violations from (select *, {_ROW} as r from f)""")
def ladder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.ladder_violations(forms(spark, sf_dir)).select("id", F.array_join("violations", ",").alias("violations"))


SHAPE = {
    "scope_check": q("in_scope", "out_of_scope", often=5), "duplicate": ["false"] * 5 + ["true"], "wellformed_check": q("single_proposition", "too_broad", "not_evaluated", often=4), "evidence_check": q("sufficient", "not_required", "insufficient", "not_evaluated", often=2),
    "inference_check": q("holds", "holds_only_with_assumptions", "gap", "not_evaluated"), "is_edge": ["true", "false"], "n_assumptions": ["0", "1", "0"], "node_type": q("fact", "mechanism", "bridge", "definition"),
}
_SHAPES = f"with f as (select id, {', '.join(fields(SHAPE, 300))} from ({LINES})), r as (select *, scope_check = 'in_scope' and not duplicate as b, scope_check = 'in_scope' and not duplicate and wellformed_check = 'single_proposition' as c, scope_check = 'in_scope' and not duplicate and wellformed_check = 'single_proposition' and evidence_check in ('sufficient', 'not_required') as d from f)"


@query(_SHAPES + """ select 'V-PR-05' as rule, cast(id as varchar) as subject from r where c and not is_edge and node_type in ('fact', 'mechanism') and evidence_check = 'not_required'
 union all select 'V-PR-14', cast(id as varchar) from r where (wellformed_check = 'not_evaluated') = b or (evidence_check = 'not_evaluated') = c or (is_edge and (inference_check = 'not_evaluated') = d)
 union all select 'V-PR-15', cast(id as varchar) from r where case when is_edge then (inference_check = 'holds_only_with_assumptions') <> (n_assumptions > 0) else n_assumptions > 0 and evidence_check not in ('sufficient', 'not_required') end""")
def ladder_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that answer a question after an earlier one stopped the ladder, or leave one open that it reached; facts without evidence; assumptions where none may be."""
    f = lines(spark, sf_dir).selectExpr("id", *fields(SHAPE, 300))
    return violations(f, "id", gates.ladder_shape())


WAVE = {"round": ["1", "2", "3"], "specs": ["0", "1", "2"], "mandatory": ["2", "3"], "productive": ["0", "1", "2", "3"]}
_WAVES = f"with f as (select id, {', '.join(fields(WAVE, 60))} from ({LINES}))"


@query(_WAVES + " select id, case when productive >= mandatory then 'sufficient' when round >= 2 or specs = 0 then 'closed' else 'followup' end as verdict, case when productive < mandatory and round < 2 and specs > 0 then round + 1 end as next_round from f")
def wave_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.wave_verdict(lines(spark, sf_dir).selectExpr("id", *fields(WAVE, 60))).select("id", "verdict", "next_round")


LEDGER = {"role": q("none", "nonspine", "spine", "bridge"), "bindings": ["0", "1", "2", "3"], "docs": ["0", "1", "2", "3"], "t12": ["0", "1"], "t34_docs": ["0", "1", "2"], "t34_publishers": ["0", "1", "2"], "rounds": ["0", "1", "2", "3"], "new_docs_last": ["0", "1"], "official": ["0", "1", "2", "3"], "academic": ["0", "1", "2", "3"], "counter": ["0", "1", "2", "3"], "industry": ["0", "1", "2", "3"], "market": ["true", "false"]}
_LEDGER = f"with f as (select id, {', '.join(fields(LEDGER, 70))} from ({LINES})), g as (select *, (t12 > 0 and docs >= 2) or (t34_docs >= 2 and t34_publishers >= 2) as tri from f)"


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("id", *fields(LEDGER, 70))


@query(_LEDGER + " select id, tri as triangulated from g")
def triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers(spark, sf_dir).select("id", gates.triangulated().alias("triangulated"))


@query(_LEDGER + " select id, case role when 'none' then true when 'nonspine' then bindings >= 1 else bindings >= 2 and docs >= case role when 'bridge' then 3 else 2 end and tri and counter > 0 end as floor_met from g")
def role_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers(spark, sf_dir).select("id", gates.role_floor().alias("floor_met"))


@query(_LEDGER + " select id, rounds >= 2 and new_docs_last = 0 and least(official, academic, counter, case when market then industry else 1 end) > 0 as saturated from g")
def saturation_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers(spark, sf_dir).select("id", gates.saturated().alias("saturated"))


EVIDENCE = {"content_kind": q("fulltext", "abstract", "metadata", None, often=3), "has_body": ["true", "true", "true", "false"], "quote_in_body": ["true", "true", "false"], "locator": q("jats:s1/p1", "", None, often=2), "roundtrip_verified": ["true", "false", None], "quote": q("pass", "fail", "na"), "polarity": ["true", "true", "false", None], "payload_in_quote": ["true", "false"], "card": ["true", "true", "true", "false"], "blob": ["true", "true", "true", "false"], "hash_ok": ["true", "true", "true", "false"], "tier": q("A", "B", "C", None)}
_EV = f"with f as (select id, ord, {', '.join(fields(EVIDENCE, 90))} from ({LINES}))"
_GRADE = "case when not has_body then 'G0' when not quote_in_body then 'G1' when content_kind = 'metadata' then 'G2' when content_kind is distinct from 'fulltext' then 'G3' when coalesce(locator, '') = '' or not coalesce(roundtrip_verified, false) then 'G4' else 'G5' end"
_INTACT = "case when not card then 'not_covered' when not blob then 'missing' when not (hash_ok and quote_in_body) then 'mutated' else 'intact' end"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("id", "ord", *fields(EVIDENCE, 90))


@query(_EV + f" select id, {_GRADE} as grade from f")
def grade_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("id", gates.grade().alias("grade"))


@query(_EV + " select id, case when not coalesce(polarity, true) then 'contradict' when quote <> 'pass' or not payload_in_quote then 'unclear' else 'support' end as verdict from f")
def attribution_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("id", gates.attribution().alias("verdict"))


@query(_EV + f" select id, {_INTACT} as integrity from f")
def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("id", gates.integrity().alias("integrity"))


@query(_EV + f""", g as (select ord as claim, {_GRADE} as grade, {_INTACT} as integrity, coalesce(tier, 'C') as tier from f)
 select claim, min(grade) as grade, max(tier) as tier, case max(case integrity when 'intact' then 0 when 'not_covered' then 1 when 'missing' then 2 else 3 end) when 0 then 'intact' when 1 then 'not_covered' when 2 then 'missing' else 'mutated' end as integrity from g group by claim""")
def worst_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select(F.col("ord").alias("claim"), gates.grade().alias("grade"), gates.integrity().alias("integrity"), "tier")
    return gates.worst_of(rows, "claim")


@query("""with f as (select user_id as claim, list(cast(ts as varchar) order by event_id) as at, min(ts) as first from events group by user_id),
 z as (select c.claim, bool_and(e.ts >= timestamp '2024-01-01 12:00:00') as ok from f c join events e on e.user_id = c.claim group by c.claim)
 select claim, claim % 7 <> 0 as frozen, claim % 7 <> 0 and claim % 5 <> 0 and ok as passed from z""")
def freeze_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are users, retrievals their events, the question frozen at one noon; every seventh has no record, every fifth another hash."""
    times = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("claim")).agg(F.collect_list(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("retrieved_at"))
    claims = times.select("claim", "retrieved_at", F.when(F.col("claim") % 7 != 0, "2024-01-01T12:00:00.000000Z").alias("frozen_at"), F.sha2(F.lit("q"), 256).alias("question_hash"), F.when(F.col("claim") % 7 != 0, F.sha2(F.when(F.col("claim") % 5 == 0, "p").otherwise("q"), 256)).alias("frozen_hash"))
    return claims.select("claim", F.col("frozen_at").isNotNull().alias("frozen"), gates.freeze().alias("passed"))


@query("""with p as (select o_orderkey as claim, l_partkey as premise from orders join lineitem on l_orderkey = o_orderkey), s as (select p_partkey as premise, case p_partkey % 6 when 0 then 'verified' when 1 then 'attributed' when 2 then 'verified' when 3 then 'attributed' when 4 then 'verified' else 'unverified' end as status from part where p_partkey % 41 <> 0)
 select o_orderkey as claim, cast(count(p.premise) as bigint) as n_premises, count(p.premise) > 0 and coalesce(bool_and(s.status is not null and s.status in ('verified', 'attributed')), false) as passed from orders left join p on p.claim = o_orderkey left join s on s.premise = p.premise group by o_orderkey""")
def inference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"))
    premises = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("premise"))
    decided = load(spark, sf_dir, "part").where("p_partkey % 41 <> 0").selectExpr("p_partkey as premise", "case when p_partkey % 6 in (0, 2, 4) then 'verified' when p_partkey % 6 in (1, 3) then 'attributed' else 'unverified' end as status")
    return gates.inference(claims, premises, decided)


@query("""select user_id as claim, cast(count(distinct event_type) as bigint) as n_digests, count(*) >= 2 and count(distinct event_type) = 1 and min(event_type) = 'click' as passed from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r <= 2 group by user_id""")
def rerun_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded runs are each user's first two events, the digest their type; scripts are never run."""
    from pyspark.sql import Window

    runs = load(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("r <= 2")
    return gates.rerun(runs.select(F.col("user_id").alias("claim"), F.col("event_type").alias("digest")), "click")

"""The queries of the evidence engine by name, with their SQL."""

from claimweave.plans import commit_plans, evidence_plans, graph_plans, independence_plans, log_plans, provenance_plans, rules_plans, sentence_plans, sequence_plans, spine_plans, status_plans, store_plans, stream_plans, text_plans  # noqa: F401
from claimweave.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Imports every query family so that the registry is complete."""

from tidemark.plans import audit, comparison, evidence, execution, extraction, feeds, flow, gates, hypotheses, inference, ladder, market, pit, scores, streams  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401

"""Importing this module registers every query."""

from evidence.plans import audit_queries, metric_queries, sample_queries, study_queries, vector_queries  # noqa: F401
from evidence.plans.catalog import ORACLES, QUERIES  # noqa: F401

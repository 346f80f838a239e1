"""Registered queries: importing this package fills the registry."""

from promptspread.plans import bandit_queries, format_queries, io_queries, instance_queries, prompt_queries, metrics_queries, rollup_queries, scoring_queries  # noqa: F401
from promptspread.plans.registry import ORACLES, QUERIES  # noqa: F401

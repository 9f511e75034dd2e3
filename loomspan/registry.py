"""Every registered query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import PRELUDE, Bundle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, ctes: str = ""):
    """Register a function of a Bundle; the oracle is a SELECT over the model's common table expressions."""
    def put(plan: Callable[[Bundle], DataFrame]) -> Callable[[Bundle], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Bundle(spark, sf_dir))
        if oracle:
            ORACLES[name] = PRELUDE + (", " + ctes if ctes else "") + oracle
        return plan

    return put


from .plans import append_queries, capture_queries, changes, comparison_queries, discovery_queries, extraction_queries, gates, intent_queries, knowledge, ledger, listings, observations, operation_log, proposal_queries, quality_checks, review_queries, rules, source_queries, structure, text_queries, timeline, transactions  # noqa: E402, F401

"""All queries of the library's own operators with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, contract_queries, measure_queries, metric_queries, order_queries, outcome_queries, ranking_queries, record_queries, runner_queries, scan_queries, study_queries, text_queries

FLAGSHIP = "o30_held_out_arms"
_MODULES = (scan_queries, contract_queries, ranking_queries, measure_queries, record_queries, study_queries, order_queries, text_queries, metric_queries, runner_queries, outcome_queries, audit_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}

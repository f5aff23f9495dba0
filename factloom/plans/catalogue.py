"""Registry of the engine's own queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import audit_queries, collection_queries, fact_queries, followup_queries, learning_queries, name_queries, replay_queries, rule_queries, stream_queries, survey_queries, tree_queries, upkeep_queries

FLAGSHIP = "rule_first_match"
_MODULES = (rule_queries, fact_queries, collection_queries, audit_queries, followup_queries, replay_queries, tree_queries, stream_queries, survey_queries, learning_queries, name_queries, upkeep_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import buffer_queries, choice_queries, chunk_queries, cluster_queries, composite_queries, fact_queries, graph_queries, memory_queries, near_queries, piece_queries, projection_queries, ranking_queries, retrieval_queries, scoring_queries, set_queries, similarity_queries, source_queries, stateful_queries, table_queries, text_queries, time_queries, topic_queries

FLAGSHIP = "bm25_topk"
_ALL = text_queries.QUERIES | retrieval_queries.QUERIES | table_queries.QUERIES | graph_queries.QUERIES | set_queries.QUERIES | scoring_queries.QUERIES | memory_queries.QUERIES | composite_queries.QUERIES | source_queries.QUERIES | chunk_queries.QUERIES | projection_queries.QUERIES | similarity_queries.QUERIES | fact_queries.QUERIES | near_queries.QUERIES | time_queries.QUERIES | buffer_queries.QUERIES | cluster_queries.QUERIES | stateful_queries.QUERIES | ranking_queries.QUERIES | choice_queries.QUERIES | piece_queries.QUERIES | topic_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import audit_queries, evaluation_queries, event_queries, evidence_queries, grounding_queries, page_queries, record_queries, retrieval_queries, run_queries, term_queries, text_queries, timestamp_queries, url_queries  # noqa: F401
from cairn.plans.catalog import QUERIES, SQL, Query


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks the corpus for every test question by substring BM25."""
    return QUERIES["bm25_topk"](spark, folder)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

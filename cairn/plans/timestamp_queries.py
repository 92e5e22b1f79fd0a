"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import timestamps
from cairn.plans.catalog import query
from cairn.sources.tables import table


def instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every timestamp of the pages and cases; a page's format habits are those of its host, a case's of its domain."""
    pages, cases = table(spark, folder, "sources"), table(spark, folder, "eval_cases")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#]+)", 1)
    of_pages = timestamps.timestamp_values(pages, "source_id", {c: F.col(c) for c in ("published_at", "retrieved_at")}, F.col("wall_zone"), host)
    of_cases = timestamps.timestamp_values(cases, "question_id", {"source_checked_at": F.col("reference_metadata.source_checked_at")}, F.col("wall_zone"), F.col("domain"))
    return timestamps.normalise_values(of_pages.unionByName(of_cases))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC instant of each value that names one."""
    return instants(spark, folder).where("status = 'resolved' AND record_id IS NOT NULL").select("record_id", "field", "instant_us").distinct()


@query()
def p3_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field were read by which format, and how many stay ambiguous or name no instant."""
    return instants(spark, folder).groupBy("field", "status", "format").agg(F.count("*").alias("n_values"), F.min("posterior").alias("least_posterior"))

"""Queries of evaluation: paired comparisons, accuracy, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import evaluation
from cairn.plans.catalog import query
from cairn.sources.tables import table

RUNS_SQL = """WITH b AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"""


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the users, made of the even and the odd events."""
    events = table(spark, folder, "events")
    return tuple(events.where(F.col("event_id") % 2 == i).groupBy("user_id", "event_type").agg(F.avg("value").alias("v")) for i in (0, 1))


@query(
    RUNS_SQL
    + """, d AS (SELECT event_type, c.v - b.v AS d FROM b JOIN c USING (user_id, event_type))
SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean_delta, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(d) / sqrt(count(*)) END, 6) AS ci95, round(count(*) FILTER (d > 0) / count(*), 6) AS positive FROM d GROUP BY event_type"""
)
def paired_delta_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Mean paired difference of each metric with its confidence interval."""
    base, new = _runs(spark, folder)
    return evaluation.paired(base, new, ["user_id"], "event_type", "v")


@query(
    RUNS_SQL
    + """, x AS (SELECT event_type, avg(v) AS v FROM b WHERE user_id % 3 > 0 GROUP BY 1), y AS (SELECT event_type, avg(v) AS v FROM c WHERE event_type <> 'view' GROUP BY 1)
SELECT coalesce(x.event_type, y.event_type) AS event_type, round(x.v, 6) AS baseline, round(y.v, 6) AS candidate, round(y.v - x.v, 6) AS delta, round(CASE WHEN x.v <> 0 THEN (y.v - x.v) / abs(x.v) END, 6) AS relative FROM x FULL JOIN y ON x.event_type = y.event_type"""
)
def full_outer_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of two runs side by side, those of only one run too."""
    base, new = _runs(spark, folder)
    a = base.where("user_id % 3 > 0").groupBy("event_type").agg(F.avg("v").alias("v"))
    b = new.where("event_type <> 'view'").groupBy("event_type").agg(F.avg("v").alias("v"))
    return evaluation.deltas(a, b, "event_type", "v")


@query(
    """WITH r AS (SELECT DISTINCT item_id, body_verified AS said, authority.satisfied AS truth FROM evidence_items), c AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (truth AND (NOT said OR said IS NULL)) AS fn FROM r)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c"""
)
def verification_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of one flag against another; undefined ratios are null."""
    rows = table(spark, folder, "evidence_items").select("item_id", F.col("body_verified").alias("said"), F.col("authority.satisfied").alias("truth")).distinct()
    return evaluation.precision_recall(rows, F.col("said"), F.col("truth"))


@query(
    """SELECT category, count(*) AS n, count(*) FILTER (trim(coalesce(query, '')) = '') AS n_blank, min(max_tool_steps) AS least, max(max_tool_steps) AS most, round(avg(max_tool_steps), 2) AS mean FROM eval_prompts GROUP BY category"""
)
def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Test items by category."""
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    return table(spark, folder, "eval_prompts").groupBy("category").agg(F.count("*").alias("n"), F.count_if(blank).alias("n_blank"), F.min("max_tool_steps").alias("least"), F.max("max_tool_steps").alias("most"), F.round(F.avg("max_tool_steps"), 2).alias("mean"))


@query(
    """WITH m AS (SELECT task_id, unnest(['source_count', 'claim_count', 'instruction_tokens', 'contamination.max_5gram_jaccard']) AS metric, unnest([CAST(metrics.source_count AS DOUBLE), metrics.claim_count, metrics.instruction_tokens, metrics.contamination.max_5gram_jaccard]) AS value, domain FROM training_tasks)
SELECT coalesce(domain, 'unknown') AS domain, metric, count(value) AS n, round(avg(value), 6) AS mean FROM m GROUP BY ALL"""
)
def flattened_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Nested metrics unfolded into rows and averaged by domain; nulls are not counted."""
    rows = table(spark, folder, "training_tasks")
    flat = evaluation.flatten_metrics(rows, F.coalesce("domain", F.lit("unknown")).alias("domain"), {"source_count": "metrics.source_count", "claim_count": "metrics.claim_count", "instruction_tokens": "metrics.instruction_tokens", "contamination.max_5gram_jaccard": "metrics.contamination.max_5gram_jaccard"})
    return flat.groupBy("domain", "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    """SELECT coalesce(reference_metadata.status, 'missing') AS status, count(*) AS n, count(DISTINCT reference_metadata.reviewer_id) AS reviewers, bool_and(reference_metadata.status = 'ready') AS all_ready FROM eval_cases GROUP BY ALL"""
)
def reference_status(spark: SparkSession, folder: str) -> DataFrame:
    """Reference states of the evaluation cases."""
    meta = F.col("reference_metadata")
    rows = table(spark, folder, "eval_cases").select(meta["status"].alias("s"), meta["reviewer_id"].alias("r"))
    return rows.groupBy(F.coalesce("s", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("r").alias("reviewers"), F.bool_and(F.col("s") == "ready").alias("all_ready"))


@query("SELECT question_id, CASE WHEN ascii(substr(sha256('7:' || question_id), 1, 1)) % 2 = 0 THEN 'A' ELSE 'B' END AS first FROM eval_cases")
def blind_order(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded A/B order of each question; the same for every run."""
    return table(spark, folder, "eval_cases").select("question_id", evaluation.blind_label(F.col("question_id"), 7).alias("first"))


@query(
    """WITH c AS (SELECT DISTINCT question_id, question, persona, ascii(substr(sha256('11:' || question_id), 1, 1)) % 2 = 0 AS f FROM eval_cases)
SELECT question_id, CASE WHEN f THEN question ELSE persona END AS a_answer, CASE WHEN f THEN persona ELSE question END AS b_answer, CASE WHEN f THEN 'baseline' ELSE 'candidate' END AS a_variant, CASE WHEN f THEN 'candidate' ELSE 'baseline' END AS b_variant FROM c"""
)
def blind_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Blind packets with their key: a case's question and persona stand for the answers of two runs."""
    rows = table(spark, folder, "eval_cases").select("question_id", "question", "persona").distinct()
    packet, keys = evaluation.blind_packet(rows.select("question_id", F.col("question").alias("answer")), rows.select("question_id", F.col("persona").alias("answer")), "question_id", "answer", 11)
    return packet.join(keys, "question_id")

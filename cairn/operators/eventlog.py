"""Folds of append-only event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import ordered


def compact(df: DataFrame, key: str, order: str, columns: list[str], deleted: Column) -> DataFrame:
    """The last state of each key of a changelog: each column's last non-null value, without keys whose last row is ``deleted``."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    folded = df.groupBy(key).agg(*last, F.max_by(deleted, F.col(order)).alias("__deleted"))
    return folded.where("NOT coalesce(__deleted, false)").drop("__deleted")


def covered(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Total length of the union of each key's intervals, and the number of its connected stretches.

    ``start`` and ``end`` are numbers; intervals that touch are one. Nulls and intervals that end before they
    start are left out.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).select(*keys, start, end)
    rows = rows.groupBy(*keys, start).agg(F.max(end).alias(end))
    reach = ordered.running(rows, keys, [start], {"__reach": ("max", end)})
    before = ordered.previous(reach, keys, [start], "__reach", "__before")
    fresh = F.col("__before").isNull() | (F.col("__before") < F.col(start))
    added = F.when(fresh, F.col(end) - F.col(start)).otherwise(F.greatest(F.col(end) - F.col("__before"), F.lit(0)))
    return before.groupBy(*keys).agg(F.sum(added).alias("covered"), F.sum(fresh.cast("bigint")).alias("n_stretches"))


def longest_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Length of the longest run of consecutive rows of each key for which ``flag`` holds (0 if there is none)."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("int"))
    placed = ordered.numbered(marked, keys, order, "__at")
    hits = ordered.numbered(placed.where("__flag = 1"), keys, order, "__hit").groupBy(*keys, (F.col("__at") - F.col("__hit")).alias("__island")).agg(F.count("*").alias("__n"))
    best = hits.groupBy(*keys).agg(F.max("__n").alias("__best")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__best")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.select(*keys).distinct().join(best, same, "left").select(*keys, F.coalesce("__best", F.lit(0)).alias("longest_run"))


def plurality(df: DataFrame, task: str, choice: str, weight: str, order: str) -> DataFrame:
    """The choice of each task with most votes, then most weight, then the earliest vote; with its agreement and confidence.

    Confidence is the mean weight of the winning votes times the agreement, rounded to 6 places.
    """
    votes = df.where(F.col(choice).isNotNull()).groupBy(task, choice).agg(F.count("*").alias("votes"), F.round(F.sum(F.coalesce(weight, F.lit(0.0))), 6).alias("weight"), F.min(order).alias("first"))
    best = F.max(F.struct("votes", "weight", (-F.col("first")).alias("early"), F.col(choice).alias("choice"))).alias("b")
    out = votes.groupBy(task).agg(best, F.sum("votes").alias("n_votes"))
    agreement = F.col("b.votes") / F.col("n_votes")
    return out.select(task, F.col("b.choice").alias("winner"), F.col("b.votes").alias("votes"), "n_votes", F.round(agreement, 6).alias("agreement"), F.round(F.col("b.weight") / F.col("b.votes") * agreement, 6).alias("confidence"))


def exposition(metrics: DataFrame, name: str, value: str, prefix: str = "cairn_") -> DataFrame:
    """Lines of the text exposition format, a type line and a sample for each metric that is not null."""
    shown = metrics.where(F.col(value).isNotNull())
    full = F.concat(F.lit(prefix), F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"))
    return shown.select(F.explode(F.array(F.struct(full.alias("metric"), F.lit(0).alias("part"), F.concat(F.lit("# TYPE "), full, F.lit(" gauge")).alias("line")), F.struct(full.alias("metric"), F.lit(1).alias("part"), F.concat(full, F.lit(" "), F.col(value).cast("string")).alias("line")))).alias("l")).select("l.*")

"""N-gram overlap of two text tables by equi-joins on the n-grams; no pairs are formed without a shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import similarity, text


def ngram_overlap(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str, n: int = 5, window: int = 13) -> DataFrame:
    """Pairs that share an ``n``-gram of tokens, with their Jaccard similarity and whether they share a ``window``-gram.

    N-grams are hashed to 64 bits for the join. The counts of shared n-grams are summed map-side. Null ids and
    null or short texts take no part; repeated rows count once.
    """

    def grams(df: DataFrame, key: str, body: str, prefix: str) -> DataFrame:
        rows = df.select(F.col(key).alias(f"{prefix}_id"), text.words(F.col(body)).alias("t")).where(F.col(f"{prefix}_id").isNotNull()).dropDuplicates([f"{prefix}_id"])
        hashes = lambda size: F.transform(similarity.ngrams(F.col("t"), size), lambda g: F.xxhash64(g))
        return rows.select(f"{prefix}_id", hashes(n).alias("short"), hashes(window).alias("long")).withColumn(f"{prefix}_n", F.size("short"))

    a, b = grams(left, left_id, left_text, "left"), grams(right, right_id, right_text, "right")

    def shared(column: str) -> DataFrame:
        x = a.select("left_id", "left_n", F.explode(column).alias("gram"))
        y = b.select("right_id", "right_n", F.explode(column).alias("gram"))
        return x.join(y, "gram").groupBy("left_id", "right_id").agg(F.count("*").alias("n"), F.first("left_n").alias("left_n"), F.first("right_n").alias("right_n"))

    short = shared("short").select("left_id", "right_id", (F.col("n") / (F.col("left_n") + F.col("right_n") - F.col("n"))).alias("jaccard"))
    long = shared("long").select("left_id", "right_id", F.lit(True).alias("in_window"))
    out = short.join(long, ["left_id", "right_id"], "left")
    return out.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), F.round("jaccard", 6).alias("jaccard"), F.coalesce("in_window", F.lit(False)).alias("in_window"))


def merge_best(df: DataFrame, key: str, order: str, longest: list[str], first: list[str]) -> DataFrame:
    """One row for each key: the longest value of some columns (the greatest of equal length) and the first non-empty one of others, by ``order``."""
    best = [F.max(F.struct(F.length(c).alias("size"), F.col(c).alias("value")))["value"].alias(c) for c in longest]
    kept = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in first]
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), *best, *kept)

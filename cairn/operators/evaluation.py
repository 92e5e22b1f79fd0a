"""Comparisons of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(base: DataFrame, new: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """n, mean difference, half width of its 95 % interval (null for one pair) and share of gains, by metric.

    Only cases of both runs count; null values are left out.
    """
    both = base.select(*keys, metric, F.col(value).alias("__base")).join(new.select(*keys, metric, F.col(value).alias("__new")), [*keys, metric])
    d = both.withColumn("d", F.col("__new") - F.col("__base")).where("d IS NOT NULL")
    n = F.count("*")
    return d.groupBy(metric).agg(n.alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.when(n > 1, 1.96 * F.stddev_samp("d") / F.sqrt(n)), 6).alias("ci95"), F.round(F.count_if(F.col("d") > 0) / n, 6).alias("positive"))


def deltas(base: DataFrame, new: DataFrame, metric: str, value: str) -> DataFrame:
    """Absolute and relative differences of all metrics of either run; null where one is missing or the base is 0."""
    a, b = base.select(metric, F.col(value).alias("a")), new.select(metric, F.col(value).alias("b"))
    both = a.join(b, metric, "full_outer")
    delta = F.col("b") - F.col("a")
    return both.select(metric, F.round("a", 6).alias("baseline"), F.round("b", 6).alias("candidate"), F.round(delta, 6).alias("delta"), F.round(F.when(F.col("a") != 0, delta / F.abs("a")), 6).alias("relative"))


def precision_recall(df: DataFrame, said: Column, truth: Column) -> DataFrame:
    """Counts and ratios of a flag against the truth. A null flag is a miss, a null truth counts for nothing."""
    c = df.agg(F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(truth & ~F.coalesce(said, F.lit(False))).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def flatten_metrics(df: DataFrame, group: Column, metrics: dict[str, str]) -> DataFrame:
    """One row (group, metric, value) for each metric of each row; flags count as 0 and 1."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(path).cast("double").alias("value")) for name, path in metrics.items()])
    return df.select(group, F.explode(pairs).alias("p")).select("*", "p.metric", "p.value").drop("p")


def blind_label(key: Column, seed: int) -> Column:
    """'A' or 'B' by a hash of key and seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.when(F.ascii(F.substring(digest, 1, 1)) % 2 == 0, "A").otherwise("B")


def blind_packet(base: DataFrame, new: DataFrame, key: str, answer: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(key, a_answer, b_answer) of the cases of both runs, in seeded order, and the key table (key, a_variant, b_variant) that is kept apart."""
    both = base.select(key, F.col(answer).alias("__base")).join(new.select(key, F.col(answer).alias("__new")), key).withColumn("__first", blind_label(F.col(key), seed) == "A")
    pick = lambda x, y: F.when(F.col("__first"), x).otherwise(y)
    packet = both.select(key, pick(F.col("__base"), F.col("__new")).alias("a_answer"), pick(F.col("__new"), F.col("__base")).alias("b_answer"))
    return packet, both.select(key, pick(F.lit("baseline"), F.lit("candidate")).alias("a_variant"), pick(F.lit("candidate"), F.lit("baseline")).alias("b_variant"))

"""Records merged by key with bounded lists, top-k with a reserved place, and packing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import ordered, ranking
from cairn.session import checkpointed


def first_distinct(df: DataFrame, keys: list[str], value: str, order: list[str], most: int, into: str) -> DataFrame:
    """(keys, into): the first ``most`` distinct values of each key, by where they first stand. Null values are left out.

    Values are made distinct and cut by place before any list is built, so no list is longer than ``most``.
    """
    once = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__first"))
    kept = ranking.quota_topk(once, keys, [F.col("__first"), F.col(value)], most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(value).alias("v")))), lambda s: s["v"]).alias(into))


def merged_candidates(df: DataFrame, key: list[str], quote: str, order: list[str], ids: str, most: int = 8) -> DataFrame:
    """(key, n, quote, first, ids): candidates of one key with their longest quote, their first place and the first ``most`` distinct ids."""
    best = df.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct(F.length(quote).alias("n"), F.col(quote).alias("q")))["q"].alias(quote), F.min(F.struct(*order)).alias("first"))
    return best.join(first_distinct(df, key, ids, order, most, "ids"), key, "left")


def reserved_topk(df: DataFrame, keys: list[str], order: list[Column], special: Column, newest: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with ``place``; if there is a ``special`` row, the first of them by ``newest`` has a place among them.

    Where it isn't one of the first rows anyway, it takes the last place from them and stands at 0.
    """
    lane = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(special.cast("int")), *newest))
    marked = df.withColumn("__lane", lane).withColumn("__kept", special & (F.col("__lane") == 1)).drop("__lane")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = marked.withColumn("place", place).where(F.col("__kept") | (F.col("place") <= most))
    away = F.max(F.col("__kept") & (F.col("place") > most)).over(Window.partitionBy(*keys))
    out = placed.withColumn("__away", away).where((F.col("place") <= most - F.col("__away").cast("int")) | F.col("__kept"))
    return out.withColumn("place", F.when(F.col("place") > most, 0).otherwise(F.col("place"))).drop("__away", "__kept")


def packed(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The rows that fit into each key's budget, taken greedily in order: a row that no longer fits is skipped, smaller ones after it may follow.

    Null and negative sizes are left out; ``order`` must tell the rows of a key apart. The rows are walked in rounds: each
    takes the longest run from the first row on that fits, by running sums over ranges (no key is one task), and
    drops what is larger than the rest of the budget. A round takes at least one row of every key that has one left.
    """
    rest = checkpointed(df.where((F.col(size) >= 0) & (F.col(size) <= budget)).withColumn("__left", F.lit(budget).cast("bigint")))
    taken = None
    while not rest.isEmpty():
        run = checkpointed(ordered.running(rest, keys, order, {"__sum": ("sum", size)}))
        fits = run.where(F.col("__sum") <= F.col("__left"))
        taken = fits.drop("__sum", "__left") if taken is None else taken.unionByName(fits.drop("__sum", "__left"))
        used = fits.groupBy(*keys).agg(F.max("__sum").alias("__used"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            used = used.withColumnRenamed(k, f"__k{i}")
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        over = run.where(F.col("__sum") > F.col("__left")).join(used, same).drop(*[f"__k{i}" for i in range(len(keys))])
        rest = checkpointed(over.withColumn("__left", F.col("__left") - F.col("__used")).where(F.col(size) <= F.col("__left")).drop("__sum", "__used"))
    return taken if taken is not None else rest.drop("__left")

"""Work spread evenly: joins on keys of which some hold a large part of all rows, and small tables in few files."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table up to this size may be dealt out over the cores, in bytes as Spark estimates it.
SMALL = 256 << 20
#: A key is hot if it has more than this part of all counted rows, so there are never more hot keys than this.
PARTS = 1000


def hot_keys(counted: DataFrame, keys: list[str], count: str, total: int, parts: int = PARTS) -> DataFrame | None:
    """(keys, __salts) of the keys of more than one in ``parts`` of all ``total`` rows; None if there is no such key.

    ``counted`` has one row for each key with its number of rows. As the numbers add up to ``total`` at most,
    no more than ``parts`` keys are hot, so they may be fetched and broadcast whatever the input's size.
    """
    limit = max(1, math.ceil(total / parts))
    rows = counted.where(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__salts")).limit(parts).collect()
    return counted.sparkSession.createDataFrame(rows, counted.select(*keys, F.lit(0).alias("__salts")).schema) if rows else None


def salted(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``df`` with __salt: rows of hot keys are spread over the key's salts by the hash of all their columns, others have 0."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    marked = df.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner", count: str = "n", parts: int = PARTS) -> DataFrame:
    """``df`` joined with ``counted``, which has one row for each key and, in ``count``, how many rows of ``df`` have it.

    Rows of a hot key are spread over salts and the one row of ``counted`` is repeated for each, so that no
    task gets more than about one part in ``parts`` of all rows for one key. ``counted`` is read twice; it
    should be a table that was written. Null keys join nothing.
    """
    hot = hot_keys(counted, keys, count, counted.agg(F.sum(count)).first()[0] or 0, parts)
    if hot is None:
        return df.join(counted, keys, how)
    other = counted.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted(df, keys, hot).join(other, [*keys, "__salt"], how).drop("__salt")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores before costly Python if it is no more than a scan of a small table in fewer files than there are cores.

    A large table is never shuffled for it (its files and row groups are many), and neither is what was shuffled anyway.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    shuffled = re.search("Join|Aggregate|Repartition|Window|Sort|LogicalRDD", plan.toString())
    small = int(str(plan.stats().sizeInBytes())) <= SMALL
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if small and not shuffled and 0 < len(df.inputFiles()) < cores else df

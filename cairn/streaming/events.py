"""Streams of events: windowed throughput, deduplication, and a keyed ledger that is merged as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A folder of parquet event files as a stream; what was read is kept in the query's checkpoint, in place of a cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def throughput(events: DataFrame, time: str, key: str, value: str, span: str = "15 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Number and sum of each key's events in sliding windows. Events later than ``late`` are dropped."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, span, slide).alias("w"), key)
    return windowed.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events whose keys were not seen within ``late`` before."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


LEDGER = "key string, text string, first_seq bigint, last_seq bigint, n bigint"


def ledger(events: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """Each key's merged record after every batch that touches it: the longest text, first and last sequence number, count.

    Records of an earlier batch are never lost; null texts fill nothing. Output mode: update.
    """

    def merge(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, first, last, n = state.get if state.exists else (None, None, None, 0)
        for rows in batches:
            n += len(rows)
            low, high = int(rows["seq"].min()), int(rows["seq"].max())
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
            for value in rows["text"].dropna():
                if best is None or (len(value), value) > (len(best), best):
                    best = value
        state.update((best, first, last, n))
        yield pd.DataFrame({"key": [group[0]], "text": [best], "first_seq": [first], "last_seq": [last], "n": [n]})

    rows = events.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(text).cast("string").alias("text"))
    return rows.groupBy("key").applyInPandasWithState(merge, LEDGER, "text string, first_seq bigint, last_seq bigint, n bigint", "update", GroupStateTimeout.NoTimeout)

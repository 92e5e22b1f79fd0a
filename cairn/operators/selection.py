"""Greedy selections whose every step depends on the steps before."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates fetched to the driver in one round.
ROUND = 50_000


def greedy_quota(df: DataFrame, order: list[str], quotas: dict[str, int], limit: int) -> DataFrame:
    """Up to ``limit`` rows in ``order``, skipping a row as soon as one of its keys has reached its quota.

    A skipped row uses no quota, so this is no set of independent top-k filters. It is sequential by nature but
    needs few rows: of each combination of keys only the first ``least quota`` rows can ever be taken, so these
    are kept by a window group limit, and only they, in rounds of at most ROUND rows, reach the driver, until
    the limit is met. Null keys are a key of their own.
    """
    keys = list(quotas)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    able = df.withColumn("__place", place).where(F.col("__place") <= min(quotas.values())).drop("__place")
    counts = {k: Counter() for k in keys}
    chosen: list[tuple] = []
    after: tuple | None = None
    while len(chosen) < limit:
        rest = able
        if after is not None:
            rest = able.where(F.struct(*order) > F.struct(*[F.lit(v).cast(able.schema[c].dataType) for c, v in zip(order, after, strict=True)]))
        batch = rest.orderBy(*order).limit(ROUND).collect()
        for row in batch:
            if all(counts[k][row[k]] < quotas[k] for k in keys):
                for k in keys:
                    counts[k][row[k]] += 1
                chosen.append(tuple(row))
                if len(chosen) >= limit:
                    break
        if len(batch) < ROUND:
            break
        after = tuple(batch[-1][c] for c in order)
    return df.sparkSession.createDataFrame(chosen, able.schema)

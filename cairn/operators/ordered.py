"""Running values over ordered groups of any size.

A window over a key that holds a third of all rows is one task. These operators cut the rows by ranges of
(key, order) into many parts, compute within each part, and carry one row of each part and key over to the
next. The ranges are written to the checkpoint folder once, since both passes must see the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpointed


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with ``__part``, ascending by keys and order; equal rows share a part."""
    columns = [F.col(c) for c in [*keys, *order]]
    spread = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return checkpointed(spread.withColumn("__part", F.spark_partition_id()))


def _carried(rows: DataFrame, keys: list[str], value: Column, over_parts: Column) -> DataFrame:
    """For each part and key, what the parts before it leave: ``__carry``."""
    left = rows.groupBy(*keys, "__part").agg(value.alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return left.withColumn("__carry", over_parts.over(earlier)).drop("__own")


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carried.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, same, "left").drop("__p", *[f"__k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[str], into: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """``df`` with running values over each key's rows up to and with the present one.

    ``into`` names (function, column) for each new column; functions are sum, max, min and count (of non-null
    values). ``order`` must tell the rows of a key apart, else equal rows are taken in any order.
    """
    rows = ranged(df, keys, order, parts)
    for name, (function, column) in into.items():
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[function]
        again = F.sum if function == "count" else fold
        carried = _carried(rows, keys, fold(column), again(F.col("__own")))
        own = fold(column).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        both = _joined(rows.withColumn("__here", own), carried, keys)
        if again is F.sum:
            value = F.when(F.col("__carry").isNull(), F.col("__here")).otherwise(F.coalesce(F.col("__here"), F.lit(0)) + F.col("__carry"))
        else:
            value = (F.greatest if function == "max" else F.least)("__here", "__carry")
        rows = both.withColumn(name, value).drop("__here", "__carry")
    return rows.drop("__part")


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str = "seq", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in its key, from 1."""
    return running(df.withColumn("__one", F.lit(1)), keys, order, {into: ("count", "__one")}, parts).drop("__one")


def placed(df: DataFrame, keys: list[str], order: list[str], into: str = "seq", size: str = "n", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in its key, from 1, and the number of its key's rows."""
    rows = ranged(df, keys, order, parts)
    own, every = F.col("__own"), Window.partitionBy(*keys)
    earlier = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__own"))
    carried = left.withColumn("__carry", F.struct(F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("before"), F.sum(own).over(every).alias("all"))).drop("__own")
    here = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    both = _joined(rows.withColumn("__here", here), carried, keys)
    return both.withColumn(into, F.col("__here") + F.col("__carry.before")).withColumn(size, F.col("__carry.all")).drop("__here", "__carry", "__part")


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, into: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``column`` of the row before in the same key; null for the first."""
    rows = ranged(df, keys, order, parts)
    last = F.max(F.struct(*order, F.struct(F.col(column).alias("v")).alias("held")))
    carried = _carried(rows, keys, last, F.max(F.col("__own")))
    here = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "__part").orderBy(*order))
    both = _joined(rows.withColumn("__here", here), carried, keys)
    return both.withColumn(into, F.coalesce("__here", "__carry.held")["v"]).drop("__here", "__carry", "__part")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """Nearest-rank percentiles of each key: the least value with at least the share of the non-null values at or below it.

    Equal values are counted map-side before anything is ordered, and no group is ever held in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = running(counts, keys, [value], {"__upto": ("sum", "__n")}, parts)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    named = totals.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)], "__total")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__t{i}"))
    ranked = upto.join(named, same)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") >= F.ceil(F.round(F.col("__total") * p, 9)), F.col(value))).alias(name) for name, p in shares.items()])


def trailing_sums(df: DataFrame, keys: list[str], seconds: str, span: int, values: dict[str, str]) -> DataFrame:
    """``df`` with sums over the rows of the same key in the ``span`` seconds up to and with each row.

    ``seconds`` is a BIGINT column. Rows are filed by slices of ``span`` and once more in the slice that follows, so
    a window is never longer than two slices of one key.
    """
    cut = F.floor(F.col(seconds) / span)
    filed = df.withColumn("__own", cut).withColumn("__slice", F.explode(F.array(cut, cut + 1)))
    reach = Window.partitionBy(*keys, "__slice").orderBy(seconds).rangeBetween(-span, 0)
    out = filed
    for name, column in values.items():
        out = out.withColumn(name, F.sum(column).over(reach))
    return out.where("__slice = __own").drop("__slice", "__own")

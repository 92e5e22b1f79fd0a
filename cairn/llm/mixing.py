"""Sources mixed to target shares of the total size, by Pareto order sampling.

Each source's share of the total fixes how often its documents occur on average: certain whole copies of
every document, and a remaining fraction that is sampled. For the sample each document draws a random number
from its key, its odds are divided by the odds of inclusion, and the documents of least quotient are taken
until the source's size is reached. The cut is found without sorting a source: sizes are summed by buckets
of the quotient (map-side first), and only the bucket in which the cut falls is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpointed

#: Buckets of the quotient, per source; the ranked bucket holds about this part of a source.
BUCKETS = 16_384
#: How near, as a part of what is drawn from a source, the last document must bring it.
CLOSE = 0.001
#: Sources of a target table; its rows, and only sums by source, come to the driver.
MAX_SOURCES = 100_000


def allocate(totals: dict[str, int], targets: dict[str, tuple[float, int]], size: float | None = None) -> tuple[float, dict[str, float]]:
    """Total size of the mix and, by source, how often its documents occur on average.

    The total is the largest at which every source with documents has its share (or ``size``, if that is
    less). Sources without documents or share occur 0 times; the others keep their shares' proportions.
    """
    live = {s: share for s, (share, _) in targets.items() if share > 0 and totals.get(s, 0) > 0 and targets[s][1] > 0}
    if not live:
        return 0.0, dict.fromkeys(targets, 0.0)
    whole = sum(live.values())
    total = min(targets[s][1] * totals[s] * whole / share for s, share in live.items())
    total = min(total, size) if size is not None else total
    return total, {s: min(float(most), live[s] / whole * total / totals[s]) if s in live else 0.0 for s, (_, most) in targets.items()}


def mix_sources(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(key, source, size, copies) of the chosen documents, and the shares reached.

    ``targets`` has source, target_share and max_repeats; rows of one source are added up (with the least
    max_repeats, a null one being 1), null sources and shares are left out. A document has ``floor`` or
    ``floor + 1`` of its source's average number of copies, never more than max_repeats. The size taken from a
    source misses its share by less than one document: the gap after the last whole draw goes to the next document
    in the order that closes it to a thousandth of the source's size, or, if none does, to the one that comes nearest. Documents with null key, null or unknown
    source, or null or zero size are never chosen; repeated rows of a key count once. The draw depends on key
    and seed only, so reruns and lost executors change nothing.

    The second table has source, target_share, share, size, n_documents, n_copies and max_copies for every
    target source, with zeros for one from which nothing is taken.
    """
    wanted = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    given = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    named = named.where(F.col("key").isNotNull() & (F.col("size") > 0)).join(F.broadcast(wanted.select("source")), "source", "left_semi")
    once = checkpointed(named.groupBy("key").agg(F.min(F.struct("source", "size")).alias("d")).select("key", "d.source", "d.size"))
    totals = {r["source"]: r["size"] for r in once.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    _, average = allocate(totals, given, total)
    plan = []
    for name, r in average.items():
        r = round(r, 12)
        whole = math.floor(r)
        plan.append((name, whole, r - whole, (r - whole) * totals.get(name, 0)))
    draw = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("fraction") / (1 - F.col("fraction")))
    kind = once.schema["key"].dataType.simpleString()

    def placed(more: list[tuple], columns: str) -> DataFrame:
        """Documents with their source's plan (one row a source, so no more than MAX_SOURCES), rank and bucket."""
        plans = spark.createDataFrame(more, "source string, whole int, fraction double, budget double" + columns)
        rows = once.join(F.broadcast(plans), "source").withColumn("u", draw).withColumn("rank", F.when(F.col("fraction") > 0, odds / (1 + odds)))
        return rows.withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int")).drop("u")

    # the bucket in which each source's budget ends
    sums = placed(plan, "").where("bucket IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("budget").alias("budget"))
    below = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = {r["source"]: (r["bucket"], r["below"]) for r in sums.withColumn("below", below).where("below < budget AND below + held >= budget").select("source", "bucket", "below").collect()}
    # the last document of that bucket that is within the budget; where nothing is cut, each document has its extra copy
    plan = [(*p, *cuts.get(p[0], (None, None))) for p in plan]
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, 0))
    inside = placed(plan, ", cut int, below bigint").where("bucket = cut").withColumn("running", running).where("below + running <= budget")
    ends = {r["source"]: (r["last"]["rank"], r["last"]["key"], r["size"]) for r in inside.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last"), F.sum("size").alias("size")).collect()}
    plan = [(*p[:5], *ends.get(p[0], (None, None, 0))[:2], p[3] - (p[5] or 0) - ends.get(p[0], (None, None, 0))[2] if p[4] is not None else 0.0) for p in plan]
    last = F.coalesce(F.struct("rank", "key") <= F.struct(F.col("last_rank").alias("rank"), F.col("last_key").alias("key")), F.lit(False)) & F.col("last_rank").isNotNull()
    extra = F.col("bucket").isNotNull() & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & last))
    columns = f", cut int, last_rank double, last_key {kind}, gap double"
    drawn = placed(plan, columns).withColumn("extra", extra)
    # the gap that is left, smaller than one document, goes to the first in the order that closes it well enough
    off = F.greatest(F.abs(F.col("size") - F.col("gap")), F.col("budget") * CLOSE)
    fits = drawn.where("NOT extra AND bucket IS NOT NULL AND size < 2 * gap").groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "key")).alias("best"))
    fillers = {r["source"]: r["best"]["key"] for r in fits.collect()}
    plan = [(*p, fillers.get(p[0])) for p in plan]
    drawn = placed(plan, columns + f", filler {kind}").withColumn("extra", extra)
    copies = F.col("whole") + F.col("extra").cast("int") + F.coalesce((F.col("key") == F.col("filler")).cast("int"), F.lit(0))
    chosen = checkpointed(drawn.select("key", "source", "size", copies.alias("copies")).where("copies > 0"))
    mix = chosen.select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), "copies")
    reached = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("max_copies"))
    shares = wanted.join(reached, "source", "left").na.fill(0, ["size", "n_documents", "n_copies", "max_copies"])
    shares = shares.withColumn("share", F.coalesce(F.try_divide("size", F.sum("size").over(Window.partitionBy())), F.lit(0.0)))
    return mix, shares.select(F.col("source").alias(source), "target_share", "share", "size", "n_documents", "n_copies", "max_copies")

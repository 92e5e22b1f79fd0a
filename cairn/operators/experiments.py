"""Reports on experiments: blind reviews, decisions from metric changes, stages at which cases fail."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_means(reviews: DataFrame, variant: str, question: str, scores: list[str]) -> DataFrame:
    """(variant, n_reviews, n_questions, mean of each score, rounded to 4 places) by variant."""
    return reviews.groupBy(variant).agg(F.count("*").alias("n_reviews"), F.count_distinct(question).alias("n_questions"), *[F.round(F.avg(c), 4).alias(c) for c in scores])


def blind_pairs(reviews: DataFrame, question: str, label: str, scores: list[str]) -> DataFrame:
    """(question, a_total, b_total, winner) of the questions with exactly one review A and one review B."""
    total = reduce(Column.__add__, [F.col(c) for c in scores])
    side = lambda x: F.max(F.when(F.col(label) == x, total))
    pairs = reviews.groupBy(question).agg(F.count("*").alias("n"), F.count_if(F.col(label) == "A").alias("n_a"), F.count_if(F.col(label) == "B").alias("n_b"), side("A").alias("a_total"), side("B").alias("b_total"))
    winner = F.when(F.col("a_total") > F.col("b_total"), "A").when(F.col("b_total") > F.col("a_total"), "B").otherwise("tie")
    return pairs.where("n = 2 AND n_a = 1 AND n_b = 1").select(question, "a_total", "b_total", winner.alias("winner"))


def unblinded(pairs: DataFrame, keys: DataFrame, question: str) -> DataFrame:
    """(winner variant, n): wins after the labels' variants are known from ``keys`` (question, a_variant, b_variant)."""
    named = F.when(F.col("winner") == "A", F.col("a_variant")).when(F.col("winner") == "B", F.col("b_variant")).otherwise("tie")
    return pairs.join(keys, question).groupBy(named.alias("winner")).agg(F.count("*").alias("n"))


def case_changes(base: DataFrame, new: DataFrame, key: str, metrics: list[str], places: int = 4) -> DataFrame:
    """(key, change of each metric, rounded, outcome) of the cases in both runs.

    'better' has a rise and no fall, 'worse' a fall and no rise, 'mixed' both, 'same' neither; unknown values on either side give a null
    change, and cases of unknown changes only are 'unknown'.
    """
    other = new.select(F.col(key), *[F.col(m).alias(f"__{m}") for m in metrics])
    rows = base.select(key, *metrics).join(other, key).select(key, *[F.round(F.col(f"__{m}") - F.col(m), places).alias(m) for m in metrics])
    any_ = lambda test: reduce(Column.__or__, [F.coalesce(test(F.col(m)), F.lit(False)) for m in metrics])
    rise, fall, known = any_(lambda c: c > 0), any_(lambda c: c < 0), any_(lambda c: c.isNotNull())
    return rows.withColumn("outcome", F.when(rise & fall, "mixed").when(rise, "better").when(fall, "worse").when(known, "same").otherwise("unknown"))


def decision(n: Column, changes: list[Column], latency: Column, least: int = 5) -> Column:
    """What changes of quality metrics suggest: 'continue' (few cases or known metrics, or no change), 'partial', 'adopt' or 'roll_back'.

    Diverging metrics, or better ones at a higher latency, suggest adopting in part.
    """
    known = reduce(Column.__add__, [c.isNotNull().cast("int") for c in changes])
    rise = reduce(Column.__or__, [F.coalesce(c > 0, F.lit(False)) for c in changes])
    fall = reduce(Column.__or__, [F.coalesce(c < 0, F.lit(False)) for c in changes])
    slower = F.coalesce(latency > 0, F.lit(False))
    return F.when((n < least) | (known < 2), "continue").when((rise & fall) | (rise & slower), "partial").when(rise, "adopt").when(fall, "roll_back").otherwise("continue")


def failing_stage(completed: Column, n_results: Column, n_bodies: Column, n_truncated: Column, answer: Column) -> Column:
    """The first stage that a case fails at; 'answer' if no earlier one is to blame."""
    return (
        F.when(~F.coalesce(completed, F.lit(False)), "engineering").when(F.trim(F.coalesce(answer, F.lit(""))) == "", "answer")
        .when(F.coalesce(n_results, F.lit(0)) == 0, "retrieval").when(F.coalesce(n_bodies, F.lit(0)) == 0, "extraction").when(F.coalesce(n_truncated, F.lit(0)) > 0, "context").otherwise("answer")
    )


def nominations(batches: DataFrame, calls: DataFrame, batch: str, item: str, confidence: str) -> DataFrame:
    """(item, appearances, nominations, mean_confidence): how often each item stood in a batch and was nominated by its call.

    ``batches`` has a row for each item of each batch, ``calls`` one for each nomination. Items that no call
    nominated have 0 and a null mean.
    """
    shown = batches.groupBy(item).agg(F.count("*").alias("appearances"))
    named = calls.join(batches.select(batch, item), [batch, item], "left_semi").groupBy(item).agg(F.count("*").alias("nominations"), F.round(F.avg(confidence), 6).alias("mean_confidence"))
    return shown.join(named, item, "left").withColumn("nominations", F.coalesce("nominations", F.lit(0)))


def order_views(items: Column, most: int = 10) -> Column:
    """Up to ``most`` orders of a list's distinct items: rotations that are evenly spaced, each with its reverse, so that positions balance."""
    once = F.array_distinct(F.filter(items, lambda x: x != ""))
    n = F.size(once)
    limit = F.greatest(F.lit(1), F.least(F.lit(most), 2 * n))
    turns = F.least(n, F.floor((limit + 1) / 2).cast("int"))
    offsets = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(turns, F.lit(1)) - 1), lambda i: F.floor(i * n / F.greatest(turns, F.lit(1))).cast("int")))
    turned = F.transform(offsets, lambda o: F.concat(F.slice(once, o + 1, n), F.slice(once, F.lit(1), o)))
    views = F.array_distinct(F.flatten(F.transform(turned, lambda v: F.array(v, F.reverse(v)))))
    return F.when(n <= 1, F.array(once)).otherwise(F.slice(views, F.lit(1), limit))


def overlapping_batches(items: Column, size: int = 5, coverage: int = 2) -> Column:
    """Batches of up to ``size`` of a list's distinct items, every item in ``coverage`` (1 to 4) batches of different company.

    Each pass walks the list with another stride that shares no factor with its length.
    """

    def divisor(a: Column, b: Column) -> Column:
        # Euclid's rule; ``a`` is at most 47, so twelve steps suffice for any ``b``
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))))
        return pair["a"]

    def dealt(once: Column, n: Column) -> Column:
        wide = F.greatest(F.lit(2), F.least(F.lit(size), n))

        def one(p: int) -> Column:
            # of any 40 whole numbers in a row one shares no factor with a number that is no more than an array's size
            found = F.try_element_at(F.filter(F.sequence(F.lit(1 + 2 * p), F.lit(1 + 2 * p) + F.least(n, F.lit(40))), lambda s: divisor(s, n) == 1), F.lit(1))
            start = (p * F.greatest(F.lit(1), F.floor(wide / 2).cast("int"))) % n
            walk = _bound(-found if p % 2 else found, lambda stride: _walk(once, n, start, stride))
            return _bound(walk, lambda w: _cut(w, n, wide))

        return F.when(n > 0, F.concat(*[one(p) for p in range(max(1, min(coverage, 4)))])).otherwise(F.array().cast("array<array<string>>"))

    return _bound(F.array_distinct(F.filter(items, lambda x: x != "")), lambda once: _bound(F.size(once), lambda n: dealt(once, n)))


def batches_of(at: Column, n: Column, size: int = 5, coverage: int = 2) -> Column:
    """(turn, batch), from 0, of the batches in which ``overlapping_batches`` puts the item with index ``at`` of a list of ``n`` distinct items.

    Nothing is read but the item's own index, so the list may have any length and is never held in one place.
    """
    wide = F.greatest(F.lit(2), F.least(F.lit(size), n))

    def found(p: int) -> Column:
        # the odd primes from 7 to 59 multiply to more than any BIGINT, so one of them doesn't divide ``n``
        tried = [(s, [q for q in range(2, s + 1) if s % q == 0 and all(q % d for d in range(2, q))]) for s in range(1 + 2 * p, 60)]
        return F.coalesce(*[F.when(reduce(lambda a, b: a & b, [n % q != 0 for q in primes], F.lit(True)), F.lit(s)) for s, primes in tried])

    def one(p: int) -> Column:
        start = (p * F.greatest(F.lit(1), F.floor(wide / 2))) % n
        # the walk is at ``at`` after so many steps of ``stride`` as make ``way`` plus some whole rounds of ``n``
        way = F.pmod(start - at if p % 2 else at - start, n)
        steps = lambda w, stride: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), stride - 1), lambda k: w + k * n), lambda x: x % stride == 0), 1) / stride
        place = _bound(F.struct(way.alias("way"), found(p).alias("stride")), lambda v: steps(v["way"], v["stride"])) if p else at
        return F.struct(F.lit(p).alias("turn"), F.floor(place / wide).alias("batch"))

    return F.array(*[one(p) for p in range(max(1, min(coverage, 4)))])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; an expression in the lambda of a list is computed again for each of its items."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walk(items: Column, n: Column, start: Column, stride: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(items, F.pmod(start + i * stride, n).cast("int") + 1))


def _cut(items: Column, n: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))

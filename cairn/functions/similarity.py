"""Overlap of token sets and n-gram sets, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens, joined by spaces; empty for fewer tokens."""
    size = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def character_ngrams(text: Column, low: int, high: int) -> Column:
    """Distinct runs of ``low`` to ``high`` characters."""
    size = F.length(text)

    def of(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(low, high + 1)]))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays of distinct values; 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct tokens; null if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * both / (F.size(a) + F.size(b)))


def support(body: Column, answer: Column, enough: int = 12) -> Column:
    """Shared tokens over the body's tokens, of which at most ``enough`` are asked for; 0 to 1."""
    need = F.greatest(F.lit(1), F.least(F.size(body), F.lit(enough)))
    return F.least(F.lit(1.0), F.size(F.array_intersect(body, answer)) / need)

"""Ranking: quotas, rank fusion, substring BM25, retrieval metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.operators import skew

#: Largest number of query terms, and of their characters, that one automaton holds and the tasks receive.
MAX_TERMS = 1_000_000
MAX_TERM_CHARS = 20_000_000


def quota_topk(df: DataFrame, keys: list[str], order: list[Column], per_key: int) -> DataFrame:
    """The first ``per_key`` rows of each key, with their ``place``.

    Spark cuts each partition to the quota before it shuffles (a window group limit), so a key that holds a third
    of all rows sends no more than the quota from each partition.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= per_key)


def fuse_ranks(df: DataFrame, group: str, item: str, stream: str, rank: str, k: int = 60, pool: int = 48) -> DataFrame:
    """Reciprocal-rank fusion: for each group the ``pool`` best items over its streams.

    Of an item's ranks in one stream the least counts. The score is the sum of 1 / (k + rank), rounded to 9 places;
    ties go to the item in more streams, with the better best rank, and then to the greater item.
    """
    best = df.groupBy(group, item, stream).agg(F.min(rank).alias("rank"))
    scored = best.groupBy(group, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_streams"), F.min("rank").alias("best_rank"))
    order = [F.desc("score"), F.desc("n_streams"), F.asc("best_rank"), F.desc(item)]
    return quota_topk(scored, [group], order, pool).withColumnRenamed("place", "fused_rank")


def _words(terms: DataFrame) -> None:
    """Raises if the terms (term) are more than one automaton should hold."""
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size["n"] > MAX_TERMS or size["chars"] > MAX_TERM_CHARS:
        raise ValueError(f"{size['n']} terms of {size['chars']} characters; at most {MAX_TERMS} of {MAX_TERM_CHARS} are searched at once")


def _automaton(words: list[str]) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, (i, len(word)))
    automaton.make_automaton()
    return automaton if words else None


def _counts(automaton: ahocorasick.Automaton | None, body: str) -> dict[int, int]:
    """How often each word stands in a text, without overlaps of a word with itself."""
    times: dict[int, int] = {}
    last: dict[int, int] = {}
    for end, (word, size) in automaton.iter(body) if automaton else ():
        if end - size >= last.get(word, -1):
            times[word] = times.get(word, 0) + 1
            last[word] = end
    return times


def term_counts(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, n_tokens, term, tf): how often each of ``terms`` (term) stands in each text as a substring, without overlaps.

    Texts and terms are lower-cased. The texts are read once by an Aho-Corasick automaton over all terms, whose
    number and size are checked before they are sent to the tasks. Texts without any term give one row with a
    null term, so that their lengths count; null texts are left out.
    """
    _words(terms)
    words = sorted(r["term"] for r in terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().collect())
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        automaton = _automaton(words)
        for batch in batches:
            row, term, count, length = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                body = value.as_py().lower()
                n = len(body.split())
                for word, times in _counts(automaton, body).items() or [(None, 0)]:
                    row.append(i)
                    term.append(None if word is None else words[word])
                    count.append(times)
                    length.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(length, pa.int64()), pa.array(term, pa.string()), pa.array(count, pa.int64())], ["key", "n_tokens", "term", "tf"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, term string, tf bigint").withColumnRenamed("key", key)


def bm25_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, query_id: str, term: str, top: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, place, score): the ``top`` texts for each query by BM25 over substring counts, scores relative to the query's best.

    ``queries`` has one row for each query and term; their number and size are checked. Texts and terms are
    lower-cased, a length is in white-space tokens, at least 1; null texts are left out, ties go to the lesser key. Two
    narrow passes read the texts: the first counts documents and lengths by term, the second scores every text
    and keeps only each partition's best, so what is shuffled doesn't grow with the texts.
    """
    wanted = queries.select(F.col(query_id).alias("q"), F.lower(term).alias("term")).where("q IS NOT NULL AND term <> ''").distinct()
    _words(wanted.select("term"))
    given = sorted((r["q"], r["term"]) for r in wanted.collect())
    ids, words = sorted({q for q, _ in given}), sorted({t for _, t in given})
    place, at = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(words)}
    askers: list[list[int]] = [[] for _ in words]
    for q, t in given:
        askers[at[t]].append(place[q])
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((words, askers))
    rows = skew.dealt(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = sent.value
        automaton, df, total, tokens = _automaton(words), np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            for value in batch.column(0):
                body = value.as_py().lower()
                df[list(_counts(automaton, body))] += 1
                total += 1
                tokens += max(1, len(body.split()))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held).astype(np.int32)), pa.array(np.append(total, df[held])), pa.array(np.append(tokens, held * 0))], ["term", "n", "tokens"])

    sums = {r["term"]: r for r in rows.select("text").mapInArrow(count, "term int, n bigint, tokens bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    n_docs, n_tokens = (sums[-1]["n"], sums[-1]["tokens"]) if -1 in sums else (0, 0)
    mean = max(n_tokens / n_docs, 1.0) if n_docs else 1.0
    weights = context.broadcast([math.log(1 + (n_docs - sums[i]["n"] + 0.5) / (sums[i]["n"] + 0.5)) if i in sums else 0.0 for i in range(len(words))])
    n_queries = len(ids)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, askers = sent.value
        automaton, idf, posts = _automaton(words), weights.value, [np.array(a, np.int64) for a in askers]
        best: list[list[tuple]] = [[] for _ in range(n_queries)]
        least = np.zeros(n_queries)
        sums = np.zeros(n_queries)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for own, value in zip(keys, batch.column(1), strict=True):
                body = value.as_py().lower()
                found = _counts(automaton, body)
                if not found:
                    continue
                size = max(1, len(body.split()))
                sums[:] = 0
                for word in sorted(found):
                    tf = found[word]
                    sums[posts[word]] += idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
                for q in np.flatnonzero((sums > 0) & (sums >= least - 1e-8)).tolist():
                    best[q].append((-round(float(sums[q]), 9), own, float(sums[q])))
                    if len(best[q]) >= 4 * top + 16:
                        best[q] = sorted(best[q])[:top]
                        least[q] = -best[q][-1][0]
        out = [(q, own, raw) for q, rows in enumerate(best) for _, own, raw in sorted(rows)[:top]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], key_type), pa.array([o[2] for o in out])], ["q", "key", "raw"])

    kind = rows.schema["key"].dataType
    key_type = to_arrow_type(kind)
    found = rows.where("key IS NOT NULL").mapInArrow(score, f"q int, key {kind.simpleString()}, raw double")
    ranked = quota_topk(found, ["q"], [F.desc(F.round("raw", 9)), F.asc("key")], top)
    peak = F.max("raw").over(Window.partitionBy("q"))
    named = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, id {queries.schema[query_id].dataType.simpleString()}")
    scored = ranked.select("q", "key", "place", F.round(F.col("raw") / peak, 6).alias("score"))
    return scored.join(F.broadcast(named), "q").select(F.col("id").alias(query_id), F.col("key").alias(key), "place", "score")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query_id: str, item: str, rank: str, k: int = 10) -> DataFrame:
    """recall, precision, reciprocal rank and nDCG at ``k`` of each query that is ranked or has relevant items.

    Rows of ``ranked`` beyond ``k`` don't count. Without relevant items recall, reciprocal rank and nDCG are null;
    without a hit the latter two are 0. Precision is over ``k``, however few items are ranked.
    """
    truth = relevant.select(F.col(query_id).alias("q"), F.col(item).alias("i")).distinct()
    many = truth.groupBy("q").agg(F.count("*").alias("n_relevant"))
    first = ranked.where(F.col(rank) <= k).groupBy(F.col(query_id).alias("q"), F.col(item).alias("i")).agg(F.min(rank).alias("rank"), F.sum(1 / F.log2(F.col(rank) + 1)).alias("gain"))
    hits = first.join(truth, ["q", "i"]).groupBy("q").agg(F.count("*").alias("hits"), F.min("rank").alias("best"), F.sum("gain").alias("dcg"))
    everyone = ranked.select(F.col(query_id).alias("q")).union(many.select("q")).distinct()
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
    out = everyone.join(many, "q", "left").join(hits, "q", "left")
    known = F.col("n_relevant").isNotNull()
    hits_, zero = F.coalesce("hits", F.lit(0)), F.lit(0.0)
    return out.select(
        F.col("q").alias(query_id), F.when(known, F.round(hits_ / F.col("n_relevant"), 4)).alias("recall"), F.round(hits_ / F.lit(k), 4).alias("precision"),
        F.when(known, F.round(F.coalesce(1 / F.col("best"), zero), 4)).alias("reciprocal_rank"), F.when(known, F.round(F.coalesce(F.col("dcg"), zero) / ideal, 4)).alias("ndcg"),
    )

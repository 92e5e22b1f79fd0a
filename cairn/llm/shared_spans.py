"""Long verbatim spans shared between records, by repeated-phrase automata.

1. Every window of ``length`` characters names one phrase: the k-gram of least hash in it. Consecutive windows
   with the same phrase form a block, about one for every (length - k) / 2 characters. The choice depends on
   the window's characters only, so equal windows name the same phrase wherever they stand.
2. Blocks whose phrase stands in two records are cut from the texts as contexts, split by a longer slice, the
   key, that all windows of a context hold at one place.
3. Recurring passages are confirmed. A block whose whole text recurs is one. Of the other blocks, and of two
   records for each recurring block with the same phrase, the windows are counted by hash; windows of one
   context that recur in the same places make one passage. One occurrence of each passage is kept as its text.
4. The passages are compiled, shard by shard, into Aho-Corasick automata, and the contexts of every document with
   a key of the shard are streamed through them. Every span comes from their hits; a passage that is hit in one
   record only (its hash was another's) is dropped, so the result is exact.
5. Hits that overlap or touch are merged into longest stretches.

A key that holds a large part of all contexts is spread over several shards, each with the key's passages. No
pairs of records are formed at any point, and nothing is broadcast but a bounded list of blocks and of at most 10,000 hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import textarrays as ta
from cairn.llm.tokenizer import spread
from cairn.operators import skew
from cairn.session import checkpointed

LENGTH = 320
PHRASE = 64
#: Window starts looked at in one go within one text; longer texts are taken in overlapping stretches.
STRETCH = 4_000_000
#: Blocks that may be broadcast to the texts (some 50 bytes each); beyond it, texts and blocks are joined by shuffle.
BROADCAST_BLOCKS = 200_000
#: Most keys that can be spread; there are fewer, as each has more than one in so many of all contexts.
MOST_SPREAD = 10_000
#: Contexts of one shard, about: what one task holds in memory at a time.
SHARD_CONTEXTS = 2_000
_PLACE = np.uint64((1 << 24) - 1)


def blocks(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, phrase: int = PHRASE, signed: bool = True) -> dict[str, np.ndarray]:
    """Blocks of the texts that lie at starts..ends in one flat array (under 2**24 long).

    Of each block: number of the text, first and last window start, place of the phrase, hash of the phrase
    and, if ``signed``, signature of the text the block's windows cover.
    """
    n, m, width = len(points), len(points) - length + 1, length - phrase + 1
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    long = np.flatnonzero(ends - starts >= length)
    if m < 1 or not len(long):
        none = np.zeros(0, np.int64)
        return {"text": none, "lo": none, "hi": none, "at": none, "phrase": none, "signature": none}
    hasher = ta.SliceHasher(points)
    grams = hasher.of_length(phrase)
    key = grams & ~_PLACE
    key |= np.arange(len(key), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    square = padded.reshape(-1, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[:m], before[width - 1 : width - 1 + m]) & _PLACE).astype(np.int64)
    edge = np.zeros(m + 1, np.int64)
    edge[starts[long]] += 1
    edge[ends[long] - length + 1] -= 1
    inside = np.cumsum(edge[:m]) > 0
    first = inside.copy()
    first[1:] &= place[1:] != place[:-1]
    first[starts[long]] = True
    lo = np.flatnonzero(first)
    text = np.searchsorted(starts, lo, side="right") - 1
    # empty texts share a start; take the one that holds the window
    text = long[np.searchsorted(starts[long], lo, side="right") - 1] if len(long) else text
    at = place[lo]
    if not signed:
        return {"text": text, "phrase": grams[at].view(np.int64)}
    hi = np.minimum(np.append(lo[1:], n) - 1, ends[text] - length)
    signature = ta.mix(hasher.of(lo, hi + length) ^ (at - lo).astype(np.uint64))
    return {"text": text, "lo": lo - starts[text], "hi": hi - starts[text], "at": at - starts[text], "phrase": grams[at].view(np.int64), "signature": signature.view(np.int64)}


def _stretches(text: str, length: int) -> Iterator[tuple[int, str]]:
    for start in range(0, max(1, len(text) - length + 1), STRETCH):
        yield start, text[start : start + STRETCH + length - 1]


def _phrase_rows(length: int, phrase: int):
    """The phrases that each text's blocks name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in _parts(batches, length):
            for _, pieces in parts:
                points, bounds = ta.flat(pieces)
                b = blocks(points, bounds[:-1], bounds[1:], length, phrase, signed=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b["text"])), pa.array(b["phrase"])], ["doc", "phrase"])

    return run


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[str]]]]]:
    """Slices of the batches with their texts, or with the stretches of one very long text, and where these begin."""
    for batch, texts in ta.chunks(batches, "text"):
        if len(texts) == 1 and len(texts[0] or "") > STRETCH + length:
            yield batch, [(offset, [piece]) for offset, piece in _stretches(texts[0], length)]
        else:
            yield batch, [(0, [t or "" for t in texts])]


def _block_rows(length: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in _parts(batches, length):
            for offset, pieces in parts:
                points, bounds = ta.flat(pieces)
                b = blocks(points, bounds[:-1], bounds[1:], length, phrase)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(b["text"]))] + [pa.array(b[c]) for c in ("phrase", "signature")] + [pa.array((b[c] + offset).astype(np.int32)) for c in ("lo", "hi", "at")],
                    ["doc", "phrase", "signature", "lo", "hi", "at"],
                )

    return run


def _contexts(length: int, phrase: int):
    """Contexts of a text's blocks, cut so that all windows of one hold its key at one place, the anchor."""
    half, wide = (length - phrase) // 2, phrase + (length - phrase) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, found = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                first, anchor, piece, marks = [], [], [], []
                for b in found:
                    # windows that start by at - half hold the left key, the others the right one
                    for lo, hi, begin in ((b["lo"], min(b["hi"], b["at"] - half), b["at"] - half), (max(b["lo"], b["at"] - half + 1), b["hi"], b["at"])):
                        if lo <= hi:
                            first.append(lo)
                            anchor.append(begin)
                            piece.append(text[lo : hi + length])
                            marks.append((b["open"], b["whole"]))
                if not first:
                    continue
                points, bounds = ta.flat(piece)
                begin = bounds[:-1] + np.array(anchor) - np.array(first)
                key = ta.SliceHasher(points, 1).of(begin, begin + wide)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        batch.column(0).take(pa.array([i] * len(first), pa.int64())),
                        pa.array(first, pa.int32()),
                        pa.array(anchor, pa.int32()),
                        pa.array([m[0] for m in marks], pa.bool_()),
                        pa.array([m[1] for m in marks], pa.bool_()),
                        pa.array(piece, pa.string()),
                    ],
                    ["key", "doc", "first", "anchor", "open", "whole", "piece"],
                )

    return run


def _windows(length: int):
    """Windows of a shard's contexts, counted by hash: how often, in which places (a sum of hashes), the least place and the last record."""

    def run(table: pa.Table) -> pa.Table:
        pieces = table.column("piece").to_pylist()
        points, bounds = ta.flat(pieces)
        lengths = np.diff(bounds) - length + 1
        at = spread(bounds[:-1], lengths)
        window = ta.SliceHasher(points).of(at, at + length).view(np.int64)
        row = np.repeat(np.arange(len(pieces)), lengths)
        key, member = (table.column(c).to_numpy() for c in ("key", "member"))
        doc = np.unique(np.array(table.column("doc").to_pylist()), return_inverse=True)[1]
        anchor = table.column("anchor").to_numpy()
        first = table.column("first").to_numpy()
        lo = first[row] + at - bounds[:-1][row]
        order = np.lexsort((lo, anchor[row], doc[row], window, key[row]))
        row, window, lo = row[order], window[order], lo[order]
        begin = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (key[row][1:] != key[row][:-1])))
        end = np.append(begin[1:], len(order)) - 1
        count, places = end - begin + 1, np.bitwise_xor.reduceat(member[row], begin)
        least, last = row[begin], row[end]
        # all contexts of a key that is not spread are here
        keep = table.column("spread").to_numpy(zero_copy_only=False)[least] | (doc[least] != doc[last])
        at, least, last = begin[keep], least[keep], last[keep]
        docs = table.column("doc").combine_chunks()
        return pa.table(
            {
                "key": key[least], "window": window[at], "n": count[keep], "places": places[keep], "doc": docs.take(pa.array(least)), "anchor": anchor[least].astype(np.int32),
                "lo": lo[at].astype(np.int32), "first": first[least], "other": docs.take(pa.array(last)),
            }
        )

    return run


def _automata(table: pa.Table) -> pa.Table:
    """Hits of a shard's passages in its contexts: the passage (by its least occurrence and size), record, begin and end."""
    kinds = table.column("passage").to_numpy(zero_copy_only=False)
    docs, firsts, pieces = (table.column(c).to_pylist() for c in ("doc", "first", "piece"))
    passages: dict[str, tuple] = {}
    for i in np.flatnonzero(kinds).tolist():
        here = (docs[i], firsts[i])
        passages[pieces[i]] = min(passages.get(pieces[i], here), here)
    out: tuple[list, ...] = ([], [], [], [], [], [])
    if passages:
        automaton = ahocorasick.Automaton()
        for text, (by, first) in passages.items():
            automaton.add_word(text, (by, first, len(text)))
        automaton.make_automaton()
        for i in np.flatnonzero(~kinds).tolist():
            for end, (by, first, size) in automaton.iter(pieces[i]):
                hit = firsts[i] + end + 1
                for column, value in zip(out, (by, first, size, docs[i], hit - size, hit), strict=True):
                    column.append(value)
    doc, place = table.schema.field("doc").type, pa.int32()
    return pa.table([pa.array(c, t) for c, t in zip(out, (doc, place, place, doc, place, place), strict=True)], ["by", "first", "size", "doc", "lo", "end"])


def _filed(rows: DataFrame, hot: DataFrame | None, shards: int) -> DataFrame:
    """``rows`` with their shard, whether their key is spread, and over how many salts."""
    marked = rows.withColumn("__salts", F.lit(None).cast("int")) if hot is None else rows.join(F.broadcast(hot), "key", "left")
    spread_ = F.col("__salts").isNotNull()
    return marked.withColumn("spread", spread_).withColumn("shard", F.when(spread_, F.col("key")).otherwise(F.pmod("key", F.lit(shards))))


def shared_spans(df: DataFrame, key: str, text: str, length: int = LENGTH, phrase: int = PHRASE) -> DataFrame:
    """``key``, ``start_char``, ``end_char`` of each longest stretch of characters that other records share.

    A character is shared if it lies in a stretch of at least ``length`` code points that also stands verbatim
    in the text of a row with another ``key``. Positions count code points from 0, ``end_char`` is exclusive;
    stretches that touch are one. Null, empty and shorter texts share nothing; rows with a null key are left
    out; repeated rows count once, as one record. Only the two columns are read.
    """
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    rows = skew.dealt(rows)
    kind = rows.schema["doc"].dataType.simpleString()
    named = rows.mapInArrow(_block_rows(length, phrase), f"doc {kind}, phrase bigint, signature bigint, lo int, hi int, at int")
    phrases = rows.mapInArrow(_phrase_rows(length, phrase), f"doc {kind}, phrase bigint")
    recurring = checkpointed(phrases.groupBy("phrase").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a <> b").select("phrase", "n"))
    found = checkpointed(skew.join_counted(named, recurring, ["phrase"]).drop("n"))
    # a signature covers the phrase's place too, so equal ones mean equal phrases
    place = F.struct("doc", "lo")
    whole = found.groupBy("signature").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count("*").alias("n")).where("one.doc <> other.doc")
    whole = checkpointed(whole)
    marked = checkpointed(skew.join_counted(found, whole.select("signature", "n", F.struct("one", "other").alias("both")), ["signature"], "left").drop("n"))
    ends = (place == F.col("both.one")) | (place == F.col("both.other"))
    # of a recurring block with an unsettled one's phrase two records stand for all, as one of them is another record
    unsettled = checkpointed(marked.where("both IS NULL").groupBy("phrase").agg(F.count("*").alias("n")))
    standing = marked.where(F.col("both").isNotNull() & ends).select("doc", "lo", "hi", "at", "phrase")
    standing = standing.join(unsettled.select("phrase"), "phrase", "left_semi").select("doc", "lo", "hi", "at", F.lit(True).alias("open"), F.lit(False).alias("whole"))
    settled = marked.where("both IS NOT NULL").select("doc", "lo", "hi", "at", F.lit(False).alias("open"), (place == F.col("both.one")).alias("whole"))
    every = marked.where("both IS NULL").select("doc", "lo", "hi", "at", F.lit(True).alias("open"), F.lit(False).alias("whole")).unionByName(settled).unionByName(standing)
    by_doc = every.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi", "at", "open", "whole")).alias("blocks"))
    if marked.count() <= BROADCAST_BLOCKS:
        by_doc = F.broadcast(by_doc)
    texts = rows.join(by_doc, "doc").select("doc", "text", "blocks")
    contexts = checkpointed(texts.mapInArrow(_contexts(length, phrase), f"key bigint, doc {kind}, first int, anchor int, open boolean, whole boolean, piece string"))
    # shards of bounded size: keys of more contexts than one shard takes are spread, the others are filed together
    total = contexts.count()
    parts = max(1, min(MOST_SPREAD, total // SHARD_CONTEXTS))
    hot = skew.hot_keys(contexts.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", total, parts)
    filed = _filed(contexts, hot, parts).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("doc", "first"), F.col("__salts")).cast("int"), F.lit(0)))
    counts = filed.where("open").withColumn("member", F.xxhash64("doc", "anchor")).groupBy("shard", "__salt")
    counts = counts.applyInArrow(_windows(length), f"key bigint, window bigint, n bigint, places bigint, doc {kind}, anchor int, lo int, first int, other {kind}")
    confirmed = counts.groupBy("key", "window").agg(F.sum("n").alias("n"), F.bit_xor("places").alias("places"), F.min(F.struct("doc", "anchor", "lo", "first")).alias("one"), F.max("other").alias("other")).where("one.doc <> other")
    # windows of one context that recur in the same places: as those are intervals around the anchor, the whole run recurs there
    runs = confirmed.groupBy("key", "one.doc", "one.anchor", "one.first", "places", "n").agg(F.min("one.lo").alias("lo"), F.max("one.lo").alias("hi")).drop("places", "n")
    cut = runs.join(contexts.where("open").select("key", "doc", "anchor", "first", "piece"), ["key", "doc", "anchor", "first"])
    cut = cut.select("key", "doc", F.col("lo").alias("first"), F.substring("piece", F.col("lo") - F.col("first") + 1, F.col("hi") - F.col("lo") + length).alias("piece"))
    passages = _filed(cut.unionByName(contexts.where("whole").select("key", "doc", "first", "piece")).withColumn("passage", F.lit(True)), hot, parts)
    passages = passages.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    columns = ["key", "doc", "first", "piece", "passage", "shard", "__salt"]
    streamed = filed.withColumn("passage", F.lit(False)).select(columns).unionByName(passages.select(columns))
    hits = checkpointed(streamed.groupBy("shard", "__salt").applyInArrow(_automata, f"by {kind}, first int, size int, doc {kind}, lo int, end int"))
    passage = ["by", "first", "size"]
    places = checkpointed(hits.groupBy(*passage).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a <> b").drop("a", "b"))
    spans = skew.join_counted(hits, places, passage).select("doc", "lo", "end")
    return merged(spans).select(F.col("doc").alias(key), F.col("lo").cast("bigint").alias("start_char"), F.col("end").cast("bigint").alias("end_char"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans (doc, lo, end) that overlap or touch, made one. A record's spans are as many as its own text allows."""
    order = Window.partitionBy("doc").orderBy("lo", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(reach >= F.col("lo"), 0).otherwise(1))
    numbered = marked.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "part").agg(F.min("lo").alias("lo"), F.max("end").alias("end")).drop("part")


def shared_share(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """For each row of ``df``: number of characters, of shared ones and their share. Null and empty texts: 0, 0 and null."""
    own = spans.groupBy(F.col(key).alias("__key")).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    rows = df.select(F.col(key), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    out = rows.join(own, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")))

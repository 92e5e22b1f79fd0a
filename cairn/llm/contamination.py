"""Passages of held-out test items inside training text, by suffix arrays of the training text.

Each task reads its share of the corpus in shards of bounded size. A shard's texts become one flat array of
token numbers, numbered by the test items' own vocabulary (0 for any other token, which ends every match). Its
suffixes, cut at the window length and left out where the first tokens can't start a test window, are sorted
into a suffix array; every suffix of every test item is then located in it by binary search, for the short
and the long window. The test items are the broadcast side: their size is checked, and more than one broadcast should hold
are searched in groups. The corpus is read once for each group, in a narrow stage, and only matches leave it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textarrays as ta
from cairn.llm.tokenizer import spread
from cairn.operators import skew

WINDOW = 13
RUN = 5
SHARE = 0.5
#: Size of the test items that are sent to the tasks at once, in characters; more of them are searched group by group.
GROUP_CHARS = 5_000_000
#: Characters that are removed before normalisation.
INVISIBLE = "​‌‍⁠﻿­"
_invisible = re.compile(f"[{INVISIBLE}]")

GAP, WORD, IDEOGRAPH, BREAK = 0, 1, 2, 3
SCHEMA = "record_id string, case_id string, n_runs int, n_runs_found int, longest_tokens int, char_start bigint, char_end bigint, in_window boolean"


def normalised(text: str | None) -> str:
    """Text without invisible characters, in NFKC, case-folded. Null gives ''."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _invisible.sub("", text))
        return text.casefold()
    return text.lower()


def _token_classes() -> np.ndarray:
    category = ta.category_table()
    out = np.where((category == ord("L")) | (category == ord("N")), np.uint8(WORD), np.uint8(GAP))
    out[0x5F] = WORD
    out[0x3400:0xA000] = IDEOGRAPH
    return out


_classes: np.ndarray | None = None


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of normalised texts in one flat array: hash, start, end and text number of each.

    After each text stands one token of hash 0, so that no run of tokens goes over two texts. Single
    ideographs are tokens, and otherwise longest runs of letters, digits and underscores.
    """
    global _classes
    if _classes is None:
        _classes = _token_classes()
    points, bounds = ta.flat(texts, gap="\n")
    kind = _classes[points]
    kind[bounds[1:] - 1] = BREAK
    before = np.concatenate([[GAP], kind[:-1]])
    after = np.concatenate([kind[1:], [GAP]])
    single = kind >= IDEOGRAPH
    start = np.flatnonzero(single | ((kind == WORD) & (before != WORD)))
    end = np.flatnonzero(single | ((kind == WORD) & (after != WORD))) + 1
    hashes = ta.SliceHasher(points).of(start, end)
    hashes[hashes == 0] = 1
    hashes[kind[start] == BREAK] = 0
    return hashes, start, end, np.searchsorted(bounds, start, side="right") - 1


def windows(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sortable byte strings of ``size`` token numbers from each place; ids must go on for ``size`` beyond the last."""
    kind = ">u2" if ids.dtype == np.uint16 else ">u4"
    out = np.empty((len(at), size), kind)
    for i in range(size):
        out[:, i] = ids[at + i]
    return out.view(f"S{out.dtype.itemsize * size}").ravel()


class TestItems:
    """The test items' tokens, windows and postings."""

    __test__ = False

    def __init__(self, cases: list[tuple[str, str | None]], run: int, window: int) -> None:
        self.case_ids = [c for c, _ in cases]
        self.run, self.window = run, window
        hashes, _, _, item = tokens([normalised(t) for _, t in cases])
        self.vocabulary = np.unique(hashes[hashes != 0])
        ids = np.where(hashes == 0, 0, np.searchsorted(self.vocabulary, hashes) + 1)
        self.kind = np.uint16 if len(self.vocabulary) < 65_000 else np.uint32
        self.ids = np.concatenate([ids, np.zeros(window + run, np.int64)]).astype(self.kind)
        self.item = item
        n = len(ids)
        ends = np.concatenate([np.flatnonzero(ids == 0), [n]])
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        self.width = np.dtype(self.kind).itemsize
        # distinct short windows, and the items that hold each
        at = np.flatnonzero(left >= run)
        keys = windows(self.ids, at, run)
        self.runs, back = np.unique(keys, return_inverse=True)
        pairs = np.unique(np.stack([back, item[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.run_items = pairs[:, 1]
        self.run_count = np.bincount(pairs[:, 0], minlength=len(self.runs)).astype(np.int64)
        self.run_at = np.cumsum(self.run_count) - self.run_count
        self.total = np.bincount(pairs[:, 1], minlength=len(cases)).astype(np.int64)
        # the least and the greatest key of a suffix that begins with each short window
        wide = np.zeros((len(self.runs), self.width * window), np.uint8)
        short = self.width * run
        wide[:, :short] = np.frombuffer(self.runs.tobytes(), np.uint8).reshape(-1, short)
        self.runs_low = wide.view(f"S{wide.shape[1]}").ravel()
        wide = wide.copy()
        wide[:, short:] = 255
        self.runs_high = wide.view(f"S{wide.shape[1]}").ravel()
        # long windows
        self.long_at = np.flatnonzero(left >= window)
        self.longs = windows(self.ids, self.long_at, window)
        self.run_starts = at
        self.run_of_start = back
        two = self.ids[:n].astype(np.int64)
        pair = (two[:-1] << 32 | two[1:])[(two[:-1] > 0) & (two[1:] > 0)]
        self.pairs = np.unique(pair)
        self.starts_by_item = [np.flatnonzero(item[at] == i) for i in range(len(cases))]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers, 0 for tokens of no test item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), self.kind)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(self.kind)


class Shard:
    """The sorted suffixes of one shard of the corpus."""

    def __init__(self, items: TestItems, texts: list[str]) -> None:
        self.items = items
        hashes, self.start, self.end, self.text = tokens(texts)
        n, pad = len(hashes), items.window + items.run
        self.ids = np.concatenate([items.numbers(hashes), np.zeros(pad, items.kind)])
        # a suffix can match only if its first tokens meet pair by pair in some test item
        one = self.ids[: n + pad - 1].astype(np.int64)
        both = np.flatnonzero((one[:-1] > 0) & (one[1:] > 0)) if n else np.zeros(0, np.int64)
        good = np.zeros(n + pad, bool)
        if len(both) and len(items.pairs):
            key = one[both] << 32 | one[both + 1]
            at = np.minimum(np.searchsorted(items.pairs, key), len(items.pairs) - 1)
            good[both[items.pairs[at] == key]] = True
        live = good[:n].copy()
        for i in range(1, items.run - 1):
            live &= good[i : n + i]
        at = np.flatnonzero(live)
        keys = windows(self.ids, at, items.window)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffixes from each low key to the high one."""
        return np.searchsorted(self.keys, low, side="left"), np.searchsorted(self.keys, high, side="right")

    def matches(self) -> dict[str, np.ndarray]:
        """Pairs of text and test item with their runs found, and whether a long window stands in the text."""
        items = self.items
        empty = np.zeros(0, np.int64)
        if not len(self.keys) or not len(items.runs):
            return {"pair": empty, "found": empty, "window": np.zeros(0, bool)}
        low, high = self.locate(items.runs_low, items.runs_high)
        count = high - low
        hit = self.suffixes[spread(low, count)]
        run = np.repeat(np.arange(len(items.runs)), count)
        there = np.unique(self.text[hit].astype(np.int64) * len(items.runs) + run)
        run, text = there % len(items.runs), there // len(items.runs)
        many = items.run_count[run]
        pair = np.repeat(text, many) * len(items.case_ids) + items.run_items[spread(items.run_at[run], many)]
        pair, found = np.unique(pair, return_counts=True)
        low, high = self.locate(items.longs, items.longs)
        count = high - low
        text = self.text[self.suffixes[spread(low, count)]].astype(np.int64)
        long = np.unique(text * len(items.case_ids) + np.repeat(items.item[items.long_at], count))
        return {"pair": pair, "found": found, "window": np.isin(pair, long)}

    def longest(self, text: int, item: int) -> tuple[int, int, int]:
        """Longest run of tokens that text and item share: number of tokens, first and last place in the text."""
        items = self.items
        own = items.starts_by_item[item]
        starts, runs = items.run_starts[own], items.run_of_start[own]
        low, high = self.locate(items.runs_low[runs], items.runs_high[runs])
        best = (0, 0, 0)
        for begin, lo, hi in zip(starts, low, high, strict=True):
            for suffix in self.suffixes[lo:hi][self.text[self.suffixes[lo:hi]] == text]:
                n, a, b = items.run, begin + items.run, suffix + items.run
                while items.ids[a] and a < len(items.item) and b < len(self.start) and items.ids[a] == self.ids[b]:
                    n, a, b = n + 1, a + 1, b + 1
                if (n, -suffix) > (best[0], -best[1]):
                    best = (n, int(suffix), int(b) - 1)
        return best


def find_leaks(corpus: DataFrame, record_id: str, text: str, cases: DataFrame, case_id: str = "case_id", query: str = "query", run: int = RUN, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Pairs of a corpus record and a test item that stands in it, whole or in part.

    A pair is found if ``window`` consecutive tokens of the item also stand consecutively in the record, or at
    least ``share`` of the item's distinct runs of ``run`` tokens stand in it. Columns: see SCHEMA;
    longest_tokens, char_start and char_end tell the longest verbatim match and its first place, in code
    points of the normalised text. Null, empty and blank texts and items without a run match nothing. Repeated
    rows count once, equal items each by their own case_id. Rows with a null id are left out. Only the named
    columns are read.
    """
    size = cases.select(F.sum(F.length(query))).first()[0] or 0
    groups = -(-size // GROUP_CHARS)
    if groups > 1:  # all rows of a case are in one group
        group = F.pmod(F.xxhash64(F.col(case_id).cast("string")), F.lit(groups))
        return reduce(DataFrame.unionByName, [_find(corpus, record_id, text, cases.where(group == g), case_id, query, run, window, share) for g in range(groups)])
    return _find(corpus, record_id, text, cases, case_id, query, run, window, share)


def _find(corpus: DataFrame, record_id: str, text: str, cases: DataFrame, case_id: str, query: str, run: int, window: int, share: float) -> DataFrame:
    rows = cases.select(F.col(case_id).cast("string"), F.col(query)).where(F.col(case_id).isNotNull()).distinct().collect()
    given = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or ""))

    sent = corpus.sparkSession.sparkContext.broadcast(given)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        items = TestItems(given, run, window)
        names = np.array(items.case_ids, dtype=object)
        for batch, texts in ta.chunks(batches, "text"):
            shard = Shard(items, [normalised(t) for t in texts])
            m = shard.matches()
            text_no, item = m["pair"] // max(1, len(given)), m["pair"] % max(1, len(given))
            keep = m["window"] | (m["found"] >= share * items.total[item])
            if not keep.any():
                continue
            text_no, item, found, long = text_no[keep], item[keep], m["found"][keep], m["window"][keep]
            spans = [shard.longest(t, i) for t, i in zip(text_no.tolist(), item.tolist(), strict=True)]
            offset = np.append(0, np.cumsum([len(normalised(t)) + 1 for t in texts]))[text_no]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text_no)),
                    pa.array(names[item].tolist(), pa.string()),
                    pa.array(items.total[item].astype(np.int32)),
                    pa.array(found.astype(np.int32)),
                    pa.array([s[0] for s in spans], pa.int32()),
                    pa.array([int(shard.start[s[1]] - o) for s, o in zip(spans, offset, strict=True)], pa.int64()),
                    pa.array([int(shard.end[s[2]] - o) for s, o in zip(spans, offset, strict=True)], pa.int64()),
                    pa.array(long),
                ],
                ["record_id", "case_id", "n_runs", "n_runs_found", "longest_tokens", "char_start", "char_end", "in_window"],
            )

    records = corpus.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).where("record_id IS NOT NULL AND text IS NOT NULL")
    return skew.dealt(records).mapInArrow(search, SCHEMA).dropDuplicates(["record_id", "case_id"])


def without_leaks(corpus: DataFrame, record_id: str, leaks: DataFrame) -> DataFrame:
    """The rows of ``corpus`` whose record no test item leaked into. Rows with a null id stay."""
    ids = leaks.select(F.col("record_id").alias("__leaked")).distinct()
    return corpus.join(ids, F.col(record_id).cast("string") == F.col("__leaked"), "left_anti")

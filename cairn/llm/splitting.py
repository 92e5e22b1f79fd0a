"""Oversized texts cut into pieces under a limit, at natural boundaries, with lines of overlap.

Each text gets the running sum of its sizes (characters, or tokens of a public vocabulary) and one sorted
array of boundaries for each strength: paragraphs, lines, sentences, words. The last boundary under the limit
is found by binary search, strongest kind first; where there is none the cut is hard. One narrow stage, with
nothing shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textarrays as ta
from cairn.llm.tokenizer import DEFAULT_VOCABULARY, BytePairVocabulary, shipped
from cairn.operators import skew

#: Marks that end a sentence or clause.
STOPS = ".!?;。！？；"
KINDS = ("paragraph", "line", "sentence", "word")
_newline = re.compile("\r\n?")
_stops = np.array([ord(c) for c in STOPS], np.uint32)
_closers = np.array([ord(c) for c in "\"')]}”’」』）】》"], np.uint32)
_blank: np.ndarray | None = None

PIECE = "struct<start_char: bigint, end_char: bigint, size: bigint, overlap_lines: int, cut: string, text: string>"


def blanks(points: np.ndarray) -> np.ndarray:
    """Flags of white space."""
    global _blank
    if _blank is None:
        _blank = np.array([chr(c).isspace() for c in range(0x3001)])
    return (points < len(_blank)) & _blank[np.minimum(points, len(_blank) - 1)]


class Boundaries:
    """The places at which one text (with LF line ends) may be cut: a place p cuts before character p."""

    def __init__(self, text: str) -> None:
        points = ta.code_points(text)
        n = self.n = len(points)
        blank = blanks(points)
        feed = np.flatnonzero(points == 10)
        self.lines = np.concatenate([[0], feed + 1])
        ends = np.concatenate([feed, [n]])
        stop = np.isin(points, _stops)
        empty = np.array([bool(blank[a:b].all()) for a, b in zip(self.lines, ends, strict=True)]) if len(ends) < n else ends == self.lines
        paragraph = self.lines[1:][empty[:-1] & ~empty[1:]]
        # a sentence ends after its stop, closing marks and the blanks behind them
        after_stop = np.zeros(n + 1, bool)
        after_stop[1:] = stop
        closer = np.isin(points, _closers)
        for i in np.flatnonzero(closer & after_stop[:-1]):
            j = i
            while j < n and closer[j]:
                after_stop[j], after_stop[j + 1] = False, True
                j += 1
        wide = np.isin(points, _stops[4:])
        sentence = np.flatnonzero(after_stop[:n])
        strong = blank[sentence] | wide[np.maximum(sentence - 1, 0)] | closer[np.maximum(sentence - 1, 0)]
        sentence = sentence[strong]
        # words begin where blanks end
        word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1 if n else np.zeros(0, np.int64)
        moved = word[np.minimum(np.searchsorted(word, sentence), max(0, len(word) - 1))] if len(word) else sentence
        sentence = np.unique(np.where(blank[sentence] & (moved > sentence), moved, sentence)) if len(sentence) else sentence
        self.by_kind = (paragraph, self.lines[1:], sentence, word)
        self.natural = np.unique(np.concatenate([*self.by_kind, [n]]))
        breaks = np.concatenate([[-1], np.flatnonzero(blank | stop), [n]])
        self.longest_run = int(np.max(np.diff(breaks))) - 1
        self.longest_line = int(np.max(ends - self.lines))


def pieces(b: Boundaries, sums: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """Start, end, lines of overlap and kind of cut of each piece. ``sums[p]``: size of the characters before p."""
    start, done, lines, n = 0, 0, 0, b.n
    while True:
        far = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1
        if far >= n:
            yield start, n, lines, "end"
            return
        far = max(far, done + 1)
        cut, kind = far, "hard"
        # the strongest boundary in the second half of the piece, else the last one of any kind
        half = max(done, int(np.searchsorted(sums, sums[start] + limit // 2)))
        best = 0
        for name, places in zip(KINDS, b.by_kind, strict=True):
            i = int(np.searchsorted(places, far, side="right")) - 1
            if i >= 0 and places[i] > done:
                if places[i] > half:
                    cut, kind = int(places[i]), name
                    break
                if places[i] > best:
                    best = cut = int(places[i])
                    kind = name
        yield start, cut, lines, kind
        # step back by whole lines, fewer only if the next piece could not begin later or reach a boundary past the cut within the limit
        after = int(b.natural[np.searchsorted(b.natural, cut, side="right")])
        after = after if sums[after] - sums[cut] <= limit else cut + 1
        line = int(np.searchsorted(b.lines, cut, side="left"))
        first = max(0, line - overlap)
        while first < line and (b.lines[first] <= start or sums[after] - sums[b.lines[first]] > limit):
            first += 1
        lines = line - first
        start, done = (int(b.lines[first]) if lines else cut), cut


def token_sums(text: str, table: BytePairVocabulary) -> np.ndarray:
    """Number of ids of the vocabulary that begin before each character, with the total at the end."""
    ids, _ = table.encode([text])
    points = ta.code_points(text)
    width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    place = np.cumsum(width) - width
    begin = np.cumsum(table.bytes_of(ids)) - table.bytes_of(ids)
    weight = np.bincount(np.searchsorted(place, begin, side="right") - 1, minlength=len(points)) if len(points) else np.zeros(0, np.int64)
    return np.append(0, np.cumsum(weight))


def split_texts(df: DataFrame, key: str, text: str, limit: str, overlap: str, unit: str = "chars", path: str = DEFAULT_VOCABULARY, with_text: bool = True) -> DataFrame:
    """For each row of ``df``: ``key``, ``oversized``, ``long_line``, ``long_run`` and ``pieces``.

    CR LF and lone CR are one LF; lengths are code points (``unit='tokens'``: ids of the vocabulary, counted in
    the whole text). A text is oversized if it is larger than ``limit``; long_line and long_run tell that one
    of its lines, or a run without white space and stops, has more characters than ``limit``. Pieces cover
    the text, none is larger than the limit (with tokens: unless one character is), and neighbours share
    ``overlap`` whole lines, fewer only where the next piece would not begin after the last one, or could not reach
    the next boundary within the limit. A text within its limit is one piece. Null texts have no pieces and no
    kind, an empty text has none either. A null limit or one below 1 limits nothing; a null or negative overlap
    is 0. Repeated rows are repeated in the result. Only the named columns are read.
    """
    kind = df.schema[key].dataType.simpleString()
    get = shipped(df, path) if unit == "tokens" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in ta.chunks(batches, "text"):
            limits, overlaps, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for value, most, back in zip(texts, limits, overlaps, strict=True):
                if not value:
                    rows.append((False, False, False, []))
                    continue
                value = _newline.sub("\n", value)
                most = most if most and most > 0 else None
                sums = token_sums(value, get()) if unit == "tokens" else np.arange(len(value) + 1)
                if most is None or (sums[-1] <= most and len(value) <= most):
                    cuts, flags = [(0, len(value), 0, "end")], (False, False, False)
                else:
                    b = Boundaries(value)
                    cuts = pieces(b, sums, most, max(0, back or 0))
                    flags = (bool(sums[-1] > most), b.longest_line > most, b.longest_run > most)
                rows.append((*flags, [{"start_char": s, "end_char": e, "size": int(sums[e] - sums[s]), "overlap_lines": o, "cut": c, "text": value[s:e] if with_text else None} for s, e, o, c in cuts]))
            piece = pa.struct([("start_char", pa.int64()), ("end_char", pa.int64()), ("size", pa.int64()), ("overlap_lines", pa.int32()), ("cut", pa.string()), ("text", pa.string())])
            columns = [pa.array([r[i] for r in rows], pa.bool_()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.list_(piece))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "oversized", "long_line", "long_run", "pieces"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(limit).cast("bigint").alias("limit"), F.col(overlap).cast("bigint").alias("overlap"))
    out = skew.dealt(rows).mapInArrow(run, f"key {kind}, oversized boolean, long_line boolean, long_run boolean, pieces array<{PIECE}>")
    return out.withColumnRenamed("key", key)


def size_kinds(split: DataFrame, key: str) -> DataFrame:
    """``key`` and ``kind`` for each kind of excess that :func:`split_texts` met; distinct rows without null keys."""
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("oversized", "long_line", "long_run")])
    return split.where(F.col(key).isNotNull() & F.col("oversized")).select(key, F.explode(F.array_compact(kinds)).alias("kind")).distinct()


def piece_rows(split: DataFrame, key: str) -> DataFrame:
    """One row for each piece, numbered from 0."""
    return split.select(key, F.posexplode("pieces").alias("piece_no", "piece")).select(key, "piece_no", "piece.*")

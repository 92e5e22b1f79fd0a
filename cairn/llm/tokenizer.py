"""Byte-level BPE of a public vocabulary, by batched numpy merge rounds.

A batch of texts becomes one flat code-point array. Pre-tokens are found by runs of character classes,
then cut further wherever no vocabulary entry holds the two bytes that meet, since no merge can ever cross
such a place. Distinct pieces not met before are encoded together: their symbols lie in one flat array, and
each round merges, in every piece at once, the pair of lowest rank, found by binary search over the sorted
pair keys. Pieces met before come from a table kept by the Python worker, keyed by 128-bit hashes.

Nothing is shuffled: one narrow stage reads the texts and writes the ids. The vocabulary file, of some megabytes,
is read by the driver and broadcast, so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textarrays as ta
from cairn.operators import skew

#: Where the public vocabularies lie; any path of a file of the same format can be given instead.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)
#: Pieces kept by a worker before the table starts anew; about 40 bytes each.
KEPT_PIECES = 1_000_000
#: Pieces of more bytes are merged one by one with a heap, so that one endless word costs n log n.
LONG_PIECE = 2048

SPACE, OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3, 4


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + extra)
            extra += 1
    return out


class BytePairVocabulary:
    """A vocabulary file and the tables for merging."""

    def __init__(self, content: str | bytes) -> None:
        model = json.loads(content)["model"]
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        symbols = _byte_symbols()
        self.of_byte = np.array([vocabulary[s] for s in symbols], np.int32)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.widths = np.ones(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.meets = np.zeros((256, 256), bool)
        for a, b in merges:
            if a[-1] in of_symbol and b[0] in of_symbol:
                self.meets[of_symbol[a[-1]], of_symbol[b[0]]] = True
        category = ta.category_table()
        self.kind = np.full(len(category), OTHER, np.uint8)
        self.kind[category == ord("L")] = LETTER
        self.kind[category == ord("N")] = NUMBER
        self.kind[list(ta.WHITE_SPACE)] = BLANK
        self.kind[0x20] = SPACE
        self.reset()

    def reset(self) -> None:
        self.have = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Number of bytes that each id stands for."""
        return self.widths[ids]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    # ---- pre-tokens

    def word_starts(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Flags of the code points at which a pre-token starts. ``texts``: starts of the texts, ascending.

        Pre-tokens are contractions, runs of letters, of numbers and of anything else, each with one space
        before it, and runs of white space without that space.
        """
        n = len(points)
        kind = self.kind[points]
        white = (kind == SPACE) | (kind == BLANK)
        run = np.where(white, np.uint8(SPACE), kind)
        fresh = np.zeros(n, bool)
        fresh[texts[texts < n]] = True
        start = fresh.copy()
        start[1:] |= run[1:] != run[:-1]
        ends = np.zeros(n, bool)
        ends[:-1] = start[1:]
        ends[-1:] = True
        closing = np.zeros(n, bool)
        closing[:-1] = fresh[1:]
        closing[-1:] = True
        # a run's last blank goes with what follows if it is a space, and stands alone otherwise
        last = np.flatnonzero(white & ends & ~closing)
        start[last] = True
        spaced = last[kind[last] == SPACE]
        start[spaced + 1] = False
        # contractions: a lone apostrophe that starts a pre-token, with s t m d ll ve re
        quote = np.flatnonzero((points == 0x27) & start & ends & ~closing)
        if len(quote):
            one = points[quote + 1]
            near = quote + 2
            inside = near < n
            two = np.where(inside, points[np.minimum(near, n - 1)], 0)
            two[inside & fresh[np.minimum(near, n - 1)]] = 0
            pair = ((one == 0x6C) & (two == 0x6C)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x72) & (two == 0x65))
            single = np.isin(one, (0x73, 0x74, 0x6D, 0x64))
            short, long = quote[single], quote[pair]
            start[short + 1] = False
            start[long + 1] = False
            after = np.concatenate([short + 2, long + 3])
            start[after[after < n]] = True
        return start

    # ---- merging

    def merge_long(self, piece: np.ndarray) -> list[int]:
        """Ids of one piece of many bytes, with a heap of pairs."""
        symbols = self.of_byte[piece].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        known = {(a, b): r for r, _, a, b in heap}

        def push(i: int, j: int) -> None:
            pair = (symbols[i], symbols[j])
            r = known.get(pair)
            if r is None:
                r = known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in symbols if s >= 0]

    def merge_rounds(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that start at ``starts`` in the flat array of bytes; ids and their number by piece."""
        count = len(starts)
        symbols = self.of_byte[symbols]
        last = np.zeros(len(symbols), bool)
        last[starts[1:] - 1] = True
        last[-1:] = True
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[last] = NONE
        piece = np.arange(count)
        done_piece, done_length, done_ids = [], [], []
        while len(symbols):
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                wide = np.repeat(over, lengths)
                done_piece.append(piece[over])
                done_length.append(lengths[over])
                done_ids.append(symbols[wide])
                stay = ~wide
                symbols, last, rank = symbols[stay], last[stay], rank[stay]
                piece, lengths, least = piece[~over], lengths[~over], least[~over]
                starts = np.cumsum(lengths) - lengths
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # in a run of overlapping equal pairs the first, third, ... are merged
            first = np.ones(len(hit), bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            if not first.all():
                group = np.flatnonzero(first)
                offset = np.arange(len(hit)) - np.repeat(group, np.diff(np.append(group, len(hit))))
                hit = hit[offset % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            last[hit] |= last[hit + 1]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, last, rank = symbols[keep], last[keep], rank[keep]
            starts, hit = place[starts], place[hit]
            rank[hit] = NONE
            right = hit[~last[hit]]
            rank[right] = self.ranks(symbols[right], symbols[right + 1])
            left = hit[hit > 0] - 1
            left = left[~last[left]]
            rank[left] = self.ranks(symbols[left], symbols[left + 1])
        order = np.concatenate(done_piece)
        lengths = np.concatenate(done_length)
        ids = np.concatenate(done_ids)
        at = np.cumsum(lengths) - lengths
        back = np.empty(count, np.int64)
        back[order] = np.arange(count)
        return ids[spread(at[back], lengths[back])], lengths[back]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number by text."""
        points, bounds = ta.flat(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start = self.word_starts(points, bounds[:-1])
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        data = np.frombuffer("".join(texts).encode("utf-8"), np.uint8)
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.meets[data[:-1], data[1:]]
        cut[offset[start]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        one, two = (ta.SliceHasher(data, i).of(begin, end) for i in (0, 1))
        one ^= (end - begin).astype(np.uint64)
        keys, where, back = np.unique(one, return_index=True, return_inverse=True)
        if not (two[where][back] == two).all():  # two pieces with one key: encode them all, in place
            where, back = np.arange(len(begin)), np.arange(len(begin))
            ids, lengths = self._merge(data, begin, end)
            at = np.cumsum(lengths) - lengths
        else:
            at, lengths, ids = self._known(keys, two[where], data, begin[where], end[where])
        at, lengths = at[back], lengths[back]
        out = ids[spread(at, lengths)]
        edges = np.searchsorted(begin, np.append(offset, len(data))[np.minimum(bounds, len(points))])
        total = np.append(0, np.cumsum(lengths))[edges]
        return out, np.diff(total)

    def _merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = end - begin
        long = lengths > LONG_PIECE
        symbols = data[spread(begin[~long], lengths[~long])]
        starts = np.cumsum(lengths[~long]) - lengths[~long]
        ids, counts = self.merge_rounds(symbols, starts) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if not long.any():
            return ids, counts
        all_counts = np.zeros(len(begin), np.int64)
        all_counts[~long] = counts
        parts, at = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], 0
        out = []
        for i in range(len(begin)):
            if long[i]:
                one = self.merge_long(data[begin[i] : end[i]])
                all_counts[i] = len(one)
                out.append(np.array(one, np.int32))
            else:
                out.append(parts[at])
                at += 1
        return np.concatenate(out), all_counts

    def _known(self, keys: np.ndarray, second: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of ids of each piece in a flat array, from the worker's table where it has them."""
        if len(self.have) > KEPT_PIECES:
            self.reset()
        at = np.searchsorted(self.have, keys)
        near = np.minimum(at, max(0, len(self.have) - 1))
        old = (self.have[near] == keys) if len(self.have) else np.zeros(len(keys), bool)
        same = old & (self.check[near] == second) if len(self.have) else old
        place, lengths = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place[same], lengths[same] = self.at[near[same]], self.length[near[same]]
        new = np.flatnonzero(~same)
        if not len(new):
            return place, lengths, self.ids
        ids, counts = self._merge(data, begin[new], end[new])
        place[new] = len(self.ids) + np.cumsum(counts) - counts
        lengths[new] = counts
        self.ids = np.concatenate([self.ids, ids])
        add = new[~old[new] & (end[new] - begin[new] <= LONG_PIECE)]
        spot = at[add]
        self.have = np.insert(self.have, spot, keys[add])
        self.check = np.insert(self.check, spot, second[add])
        self.at = np.insert(self.at, spot, place[add])
        self.length = np.insert(self.length, spot, lengths[add].astype(np.int32))
        return place, lengths, self.ids


def spread(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices at, at + 1, ... of each slice, one slice after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(at - (ends - lengths), lengths)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairVocabulary:
    """The vocabulary at ``path``, loaded once by each process."""
    return BytePairVocabulary(Path(path).read_bytes())


_read: dict[str, BytePairVocabulary] = {}


def shipped(df: DataFrame, path: str) -> Callable[[], BytePairVocabulary]:
    """What gives a task the vocabulary at ``path``, which is broadcast and read once by each worker."""
    content = Path(path).read_bytes()
    sent, name = df.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def get() -> BytePairVocabulary:
        if name not in _read:
            _read.clear()
            _read[name] = BytePairVocabulary(sent.value)
        return _read[name]

    return get


def encode_texts(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row of ``df``, by the byte-level vocabulary at ``path``.

    One row out for each row in, repeated rows and null keys included. Null and empty texts give an empty
    list. Strings of special tokens are ordinary text. Columns other than ``key`` and ``text`` are not read,
    so none can clash.
    """
    kind = df.schema[key].dataType.simpleString()
    get = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = get()
        for batch, texts in ta.chunks(batches, "text"):
            ids, counts = table.encode([t or "" for t in texts])
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return skew.dealt(rows).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, text: str, into: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with its text column replaced by ``into BIGINT``, the number of ids of the text (0 for null)."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    get = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = get()
        for batch, texts in ta.chunks(batches, "text"):
            _, counts = table.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["row", "n"])

    out = skew.dealt(rows).mapInArrow(run, f"row {kind}, n bigint")
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("n").alias(into))


def token_ids(column: Column | str) -> Column:
    """Number of ids in an id list; 0 for null."""
    return F.coalesce(F.size(column), F.lit(0))

"""Texts as flat numpy arrays: batching, character classes, hashes of slices.

Every operator of this subpackage that works below the row level takes Arrow batches, joins a bounded
number of texts into one flat code-point array and runs whole-array numpy over it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points of one flat array. A longer text is an array of its own.
CHUNK_CHARS = 400_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches, with the texts of each slice, of at most ``limit`` characters unless one text is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, size, texts = 0, 0, []
        for i, value in enumerate(column):
            one = value.as_py()
            n = len(one) if one else 0
            if texts and size + n > limit:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(one)
            size += n
        if texts:
            yield batch.slice(start), texts


def code_points(text: str) -> np.ndarray:
    """Code points of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def flat(texts: list[str], gap: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by ``gap``; starts of the texts and the total length."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return code_points("".join(t + gap for t in texts) if gap else "".join(texts)), starts


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[which] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class SliceHasher:
    """64-bit hashes of any slices of one array, each from two entries of a running sum."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        n = len(values)
        self.up, self.down = _power(n + 1, which)
        v = values.astype(np.uint64)
        v += np.uint64(0x51)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= self.up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(v, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def of_length(self, length: int) -> np.ndarray:
        """Hashes of all slices of one length, by start."""
        n = len(self.sums) - 1 - length + 1
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


@lru_cache(maxsize=1)
def category_table() -> np.ndarray:
    """First letter of each code point's general category, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)


#: Unicode's White_Space property.
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

"""Words, word hashes and word n-grams of many texts at once, on the bytes of an Arrow column.

All functions are vectorised over the texts of a slice; a slice holds a few megabytes of text (or
one longer text), so that a task's memory does not depend on the number of its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes that belong to words: all but white space / letters, digits and everything outside ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _ODD, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes of all texts of the slice
    starts: np.ndarray  # first byte of every word
    ends: np.ndarray  # one past the last byte
    first: np.ndarray  # word number at which each text begins; one more than there are texts
    sums: np.ndarray  # running sum of the byte terms; a word's prefix is a difference of two

    def prefix(self, length: int | None = None) -> np.ndarray:
        """Hashes of the first ``length`` bytes of every word, or of the whole words."""
        stop = self.ends if length is None else np.minimum(self.ends, self.starts + length)
        return mix(self.sums[stop] - self.sums[self.starts])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def packed(texts: pa.Array) -> pa.Array:
    """Every text of a column compressed by itself; a null is an empty text."""
    data, at = text_bytes(texts)
    return pa.array([zlib.compress(data[a:b], 1) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def joined(texts: Sequence[bytes]) -> pa.Array:
    """A string column of texts that are at hand as bytes."""
    at = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(b"".join(texts)))


def words(texts: pa.Array, member: np.ndarray) -> Words:
    data, at = text_bytes(texts)
    inside = member[data]
    data = LOWER[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    lengths = ends - starts
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(starts):
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
        sums[1:][inside] = terms
        np.cumsum(sums, out=sums)
    return Words(data, starts, ends, np.searchsorted(starts, at), sums)


def join_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive values of ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * _ODD + h[j : len(h) - n + 1 + j])
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For every text the sorted set of its word ``n``-grams; the whole text if it is shorter."""
    found = words(texts, NOT_SPACE)
    h = found.prefix()
    grams = join_hash(h, n)
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield join_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``SLICE_BYTES`` of text each, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)

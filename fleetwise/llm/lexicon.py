"""Ids of the chunks of many texts, each distinct chunk worked out once.

An encoder that treats chunks of a text independently need not see every occurrence of a chunk. A
``Lexicon`` keeps what it has worked out and lays the ids of all chunks of a slice out with array
operations: chunks of up to 15 bytes are two 64-bit numbers (bytes and length, so nothing is told
apart by a hash alone), looked up in a table with one place per hash; what misses its place is made
distinct and looked up by its bytes. Memory is bounded: beyond ``room`` chunks it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from fleetwise.llm.kernel import mix

ROOM = 1 << 20  # chunks that are kept
SLOT_BITS = 18
SHORT = 15  # bytes of a chunk that fit its key, beside its length
LONG = 512  # bytes from which a chunk is long
LONG_ROOM = 1 << 22  # bytes of long chunks that are kept

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of at most 15 bytes as two numbers each."""
    room = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    low = eight[starts] & _MASK[np.minimum(sizes, 8)]
    high = eight[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
    return low, high | (sizes.astype(np.uint64) << np.uint64(56))


class Numbers:
    """Numbers the distinct chunks it meets, from 0 on; ``chunks`` has them by number."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.chunks: list[bytes] = []
        self.low = np.zeros(1 << SLOT_BITS, np.uint64)
        self.high = np.zeros(1 << SLOT_BITS, np.uint64)  # 0: nothing there, as no chunk has length 0
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.long = 0

    def learn(self, new: list[bytes]) -> None:
        """Called with chunks not met before, in the order of their numbers."""

    def _looked_up(self, chunks: list[bytes]) -> np.ndarray:
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if new:
            self.learn(new)
            self.known.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new))))  # noqa: B905
            self.chunks += new
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of the chunks of ``data`` that begin at ``starts``."""
        out = np.empty(len(starts), np.int64)
        raw = data.tobytes()
        cut = lambda at: [raw[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist())]  # noqa: E731, B905
        short = sizes <= SHORT
        at = np.flatnonzero(short)
        low, high = keys(data, starts[at], sizes[at])
        h = mix(low * _ODD + mix(high.copy()))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out[at] = self.at[slot]
        miss = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(miss):
            _, some, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[some]
            if (low[one][back] != low[miss]).any() or (high[one][back] != high[miss]).any():
                one, back = miss, np.arange(len(miss))  # two chunks of one hash: each by itself
            number = self._looked_up(cut(at[one]))
            out[at[miss]] = number[back]
            self.low[slot[one]], self.high[slot[one]], self.at[slot[one]] = low[one], high[one], number
        long = np.flatnonzero(~short)
        if len(long):
            out[long] = self._looked_up(cut(long))
        return out


class Lexicon(Numbers):
    """Ids of chunks: ``encode`` gives those of a list of distinct chunks, one sequence for each."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], room: int = ROOM) -> None:
        self.encode, self.room = encode, room
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.first = np.zeros(1 << 12, np.int64)  # where a chunk's ids begin in ``flat``
        self.count = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def learn(self, new: list[bytes]) -> None:
        found = self.encode(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin, stop = len(self.chunks), len(self.chunks) + len(new)
        while len(self.first) < stop:
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        ends = self.used + np.cumsum(sizes)
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[begin:stop], self.count[begin:stop] = ends - sizes, sizes
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.used = int(ends[-1])

    def lay_out(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and how many each chunk has."""
        sizes = ends - starts
        if len(self.known) > self.room or self.long > LONG_ROOM:
            self.clear()
        self.long += int(sizes[sizes >= LONG].sum())
        number = self.numbers(data, starts, sizes)
        counts = self.count[number]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.first[number] - (stops - counts), counts)]
        return ids, counts

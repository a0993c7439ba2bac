"""Simple-8b: numbers in 64-bit words, a selector of 4 bits and as many numbers as fit beside it.

Numbers are cut into blocks of 256. A block begins with a word of its own, and the places where
blocks begin are kept, so that any block is read alone and all blocks are read at once. A number
that no selector holds (60 bits or more) is an escape: its word has selector 0 and names a place in a list
of plain numbers. All functions work on arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 256

# Numbers in a word, and bits of each, for the selectors 1 to 14; 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_TAKES = np.array([1, *COUNTS], np.int64)


class Packed(NamedTuple):
    words: np.ndarray  # uint64
    begins: np.ndarray  # uint32: the first word of every block, and one past the last word
    escapes: np.ndarray  # uint64


def pack(numbers: np.ndarray) -> Packed:
    """Greedily, the selector that takes the most numbers first; a block's last word may be part empty."""
    x = np.ascontiguousarray(numbers, np.uint64)
    n = len(x)
    if not n:
        return Packed(np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64))
    blocks = -(-n // BLOCK)
    # one row for each block, with room behind it, so that no window reaches into the next block
    wide = np.zeros((blocks, BLOCK + COUNTS[0]), np.int8)
    width = np.zeros(blocks * BLOCK, np.int8)
    width[:n] = np.frexp(x.astype(np.float64))[1]  # bits; from 2**53 on one more may be said
    wide[:, :BLOCK] = width.reshape(blocks, BLOCK)
    selector = np.zeros((blocks, BLOCK), np.int8)  # of a word that begins at each number
    widest, size = wide, 1  # the widest of so many numbers from each on
    for k in range(len(COUNTS) - 1, -1, -1):
        while size < COUNTS[k]:
            step = min(size, COUNTS[k] - size)
            more = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=more[:, :-step])
            widest, size = more, size + step
        np.copyto(selector, k + 1, where=widest[:, :BLOCK] <= BITS[k])
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    selector = selector.reshape(-1)
    pos, alive = np.arange(blocks) * BLOCK, np.arange(blocks)
    began = np.zeros(blocks * BLOCK, bool)
    while len(alive):
        began[pos] = True
        pos = pos + _TAKES[selector[pos]]
        on = pos < ends[alive]
        pos, alive = pos[on], alive[on]
    began = np.flatnonzero(began)
    chosen = selector[began]
    begins = np.searchsorted(began, np.arange(blocks + 1) * BLOCK).astype(np.uint32)
    stop = np.minimum(began + _TAKES[chosen], ends[began // BLOCK])
    words = np.zeros(len(began), np.uint64)
    room = np.concatenate([x, np.zeros(COUNTS[0], np.uint64)])
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero(chosen == k + 1)
        if not len(mine):
            continue
        word, at = np.full(len(mine), (k + 1) << 60, np.uint64), began[mine]
        whole = (stop[mine] - at == count).all()
        for j in range(count):
            part = room[at + j] if whole else np.where(at + j < stop[mine], room[at + j], np.uint64(0))
            word |= part << np.uint64(bits * j)
        words[mine] = word
    out = np.flatnonzero(chosen == 0)
    words[out] = np.arange(len(out), dtype=np.uint64)
    return Packed(words, begins, x[began[out]])


def unpack(packed: Packed, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The numbers of the blocks ``first`` to ``last`` (all, if not given) of ``n`` packed numbers."""
    blocks = len(packed.begins) - 1
    last = blocks if last is None else min(last, blocks)
    if last <= first:
        return np.zeros(0, np.uint64)
    begins = packed.begins.astype(np.int64)
    words = packed.words[begins[first] : begins[last]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    takes = _TAKES[selector]
    # where a word's numbers go: the sum of those before it in its block, from the block's own place on
    before = np.cumsum(takes) - takes
    heads = begins[first:last] - begins[first]
    words_in = np.diff(begins[first : last + 1])
    base = np.arange(last - first) * BLOCK
    at = before - np.repeat(before[heads] - base, words_in)
    total = min(n, last * BLOCK) - first * BLOCK
    limit = np.repeat(np.minimum(base + BLOCK, total), words_in)
    out = np.zeros(total, np.uint64)
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero(selector == k + 1)
        if not len(mine):
            continue
        value, place, stop = words[mine], at[mine], limit[mine]
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            inside = place + j < stop
            part = (value >> np.uint64(bits * j)) & mask
            if inside.all():
                out[place + j] = part
            else:
                out[(place + j)[inside]] = part[inside]
    lone = np.flatnonzero(selector == 0)
    out[at[lone]] = packed.escapes[(words[lone] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out

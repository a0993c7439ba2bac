"""Words that differ by one character, found by permuterm rotations.

Words are counted over all texts. Each word, with a terminator behind it, is turned to all its rotations; a rotation
without its last character is what is left of the word when that character is skipped. All rotations are
sorted by such keys, so words that differ by one replaced character stand together under the key that skips it, with the
word, if there is one, that lacks the character and nothing else. One scan of the sorted rows sees each
of these groups, and gives every member one row: how many neighbours it met and the best of them. No pair
is written down. A group has at most one member for each character of the alphabet, 91 in all, so none is large.

Each neighbour is met once: words of one length at the one place where they differ, and of a run of equal characters only the
first is the one that is left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import LOWER, slices, text_bytes
from fleetwise.llm.lexicon import Numbers
from fleetwise.shared import kept, scope, stored

END = "$"  # the terminator; no character of a word
ROOM = 1 << 18  # words counted in a task before it hands its counts on

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


@dataclass(frozen=True)
class Variants:
    """The shortest word and the fewest occurrences that count, how much more frequent a form is, and
    which share of runs (one in ``typos``) loses a character first; 0 loses none."""

    length: int = 6
    occurrences: int = 5
    ratio: int = 5
    typos: int = 199


# -- counting ------------------------------------------------------------------------------------

_bytes = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _bytes = np.where(_bytes & 1, (_bytes >> 1) ^ np.uint32(0xEDB88320), _bytes >> 1)
_shifts: dict[int, list[np.ndarray]] = {}


def crc_behind(crc: np.ndarray, size: int) -> np.ndarray:
    """What a CRC-32 adds to that of ``size`` further bytes, so that the exclusive or of both is that of the whole."""
    if size not in _shifts:
        tables = []
        for k in range(4):
            v = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(size):
                v = (v >> np.uint32(8)) ^ _bytes[v & np.uint32(255)]
            tables.append(v)
        if size > 256:
            return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]
        _shifts[size] = tables
    a, b, c, d = _shifts[size]
    return a[crc & 255] ^ b[(crc >> 8) & 255] ^ c[(crc >> 16) & 255] ^ d[crc >> 24]


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of letters of all texts: bytes, starts, ends, code points, and the text that each is in."""
    data, at = text_bytes(texts)
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and any other
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    data = LOWER[data]
    # padded by a byte outside at both ends and cut where a text begins
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    leads = np.append(0, np.cumsum(lead))
    points = ends - starts - (leads[ends] - leads[starts])
    return data, starts, ends, points, np.searchsorted(at, starts, "right") - 1


def without(word: bytes, place: int) -> bytes:
    text = word.decode()
    return (text[:place] + text[place + 1 :]).encode()


def word_counts(docs: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With ``typos``, a run of a document (all
    its occurrences there) loses one code point where the CRC-32 of ``doc_id:run`` is a multiple of it.
    A null doc_id has no digits; a null text has no words. Equal rows count as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, edited = Numbers(), np.zeros(1 << 12, np.int64), Counter()
        crcs = np.zeros(0, np.uint32)  # of the chunks, by number

        def out() -> Iterator[pa.RecordBatch]:
            counts = Counter(edited)
            at = np.flatnonzero(total[: len(seen.chunks)])
            plain = [seen.chunks[k] for k in at.tolist()]
            words = [*plain, *counts]
            sums = np.concatenate([total[at], np.fromiter(counts.values(), np.int64, len(counts))])
            if words:
                for a in range(0, len(words), 1 << 16):
                    part = pa.array(words[a : a + (1 << 16)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([part, pa.array(sums[a : a + (1 << 16)])], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                data, starts, ends, points, text = runs(part.column("text"))
                long = points >= rule.length  # shorter runs give no word that counts
                starts, sizes, points, text = starts[long], (ends - starts)[long], points[long], text[long]
                number = seen.numbers(data, starts, sizes)
                pairs, first, n = np.unique(text * len(seen.chunks) + number, return_index=True, return_counts=True)
                text, number, sizes, points = text[first], number[first], sizes[first], points[first]
                if len(total) < len(seen.chunks):
                    total = np.append(total, np.zeros(2 * len(seen.chunks) - len(total), np.int64))
                if rule.typos:
                    new = seen.chunks[len(crcs) :]
                    crcs = np.concatenate([crcs, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
                    ids = part.column("doc_id").to_pylist()
                    front = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)[text]
                    h = crcs[number]
                    for size in np.unique(sizes).tolist():
                        mine = sizes == size
                        h[mine] ^= crc_behind(front[mine], size)
                    typo = h % np.uint32(rule.typos) == 0
                    for k in np.flatnonzero(typo).tolist():
                        if points[k] > rule.length:
                            edited[without(seen.chunks[number[k]], int(h[k]) % int(points[k]))] += int(n[k])
                    number, n = number[~typo], n[~typo]
                np.add.at(total, number, n)
                if len(seen.chunks) > ROOM:
                    yield from out()
                    seen.clear()
                    total[:] = 0
                    edited.clear()
                    crcs = crcs[:0]
        yield from out()

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.occurrences)


# -- neighbours ----------------------------------------------------------------------------------


def rotations(words: DataFrame) -> DataFrame:
    """``key``, ``word``, ``n``, ``edited``, ``first`` of all rotations.

    Under its own rotations a word stands as a whole (``edited`` false); under the rotations without their last character it
    stands as one that has that character more. ``first``: the character begins a run of equal ones.
    """
    turn = lambda skip: f"concat(substring(word, i + 1 + {skip}), '{END}', substring(word, 1, i))"
    whole = f"transform(sequence(0, length(word)), i -> struct({turn(0)} AS key, false AS edited, false AS first))"
    first = "i = 0 OR substring(word, i, 1) <> substring(word, i + 1, 1)"
    short = f"transform(sequence(0, length(word) - 1), i -> struct({turn(1)} AS key, true AS edited, {first} AS first))"
    rows = words.where("length(word) > 0").select("word", "n", F.explode(F.expr(f"concat({whole}, {short})")).alias("r"))
    return rows.select("r.key", "word", "n", "r.edited", "r.first")


def _scan(part: pa.RecordBatch) -> pa.RecordBatch:
    """Whole groups of rows, sorted by key, falling n and word: each member's neighbours and the best one."""
    rows = part.num_rows
    keys = part.column("key")
    group = np.append(0, np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))) if rows else np.zeros(0, np.int64)
    groups = int(group[-1]) + 1 if rows else 0
    edited, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("edited", "first"))
    none = rows
    head = lambda at: _first(group[at], at, groups, none)
    one = np.flatnonzero(edited)
    lead = head(one)
    second = head(one[lead[group[one]] != one])
    whole, begins = head(np.flatnonzero(~edited)), head(np.flatnonzero(first))
    others = np.bincount(group[one], minlength=groups)[group]
    firsts = np.bincount(group[first], minlength=groups)[group]
    at = np.arange(rows)
    has = (whole < none)[group]
    near = np.where(edited, others - 1 + (first & has), firsts)
    # rows are in the order of preference, so of two candidates the one that comes first is the better
    peer = np.where(lead[group] == at, second[group], lead[group])
    best = np.where(edited, np.where(first, np.minimum(peer, whole[group]), peer), begins[group])
    met = np.flatnonzero(near > 0)
    take = pa.array(best[met])
    return pa.RecordBatch.from_arrays(
        [part.column("word").take(pa.array(met)), pa.array(near[met]), part.column("word").take(take), part.column("n").take(take)],
        ["word", "near", "best", "best_n"],
    )


def _first(group: np.ndarray, at: np.ndarray, groups: int, none: int) -> np.ndarray:
    out = np.full(groups, none, np.int64)
    out[group[::-1]] = at[::-1]
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n`` of every word that has a word one edit away.

    ``best`` is the one with the largest ``n``, of equal ones the smallest in code-point order. Words are distinct.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rotations(words).repartitionByRange(parts, "key").sortWithinPartitions("key", F.desc("n"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = pc.equal(batch.column("key"), batch.column("key")[-1]).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(same))
            held = batch.slice(cut)
            if cut:
                yield _scan(batch.slice(0, cut))
        if held is not None:
            yield _scan(held)

    met = rows.mapInArrow(run, "word string, near bigint, best string, best_n bigint")
    order = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(order).alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for pairs ``word``, ``form`` (null: none): the last form that the chain reaches.

    Every round follows twice as many forms as the one before; a chain has no circle, as forms grow in count.
    """
    with scope():
        at = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
        while True:
            ahead = at.where("word <> root").toDF("root", "next")
            step = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            at = step.select("word", "root")
            if step.where("moved").isEmpty():
                return kept(at, "roots")


def group_variants(docs: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the texts that counts.

    ``form`` is the best neighbour if it is at least ``ratio`` times as frequent, else null; ``root`` is where
    forms of forms end, the word itself if it has none. No words: no rows. Other columns are not looked at.
    """
    with scope():
        words = stored(word_counts(docs, rule), "words")
        near = neighbours(words)
        clear = F.col("best_n") >= rule.ratio * F.col("n")
        found = stored(
            words.join(near, "word", "left").select(
                "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n"),
            ),
            "forms",
        )
        return kept(found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n"), "variants")

"""Fill-in-the-middle texts from seekable compressed frames.

A document is stored as independent zstandard frames of at most 64 kB of text, each with the number of
units and of code points up to its end. A unit is a run of ASCII letters or any other code point. To
cut a document after so many units, the two frames that hold the cuts are found by the counts and
decompressed; all others are moved as they are. So the output, too, is a list of frames, and its
digest comes from streaming them in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import slices, text_bytes

FRAME = 1 << 16
LEVEL = 1
STORED = "doc_id bigint, marked boolean, units array<bigint>, chars array<bigint>, frames array<binary>"
OUTPUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames array<binary>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Infill:
    """How documents are cut: the seed of the hash, percentages, and the three markers.

    ``plain`` of 100 documents stay as they are, and of the others ``suffix_first`` of 100 begin with the suffix. No
    marker may begin with what another ends with; so an output can be taken apart again.
    """

    seed: int = 1
    plain: int = 10
    suffix_first: int = 20
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    @property
    def markers(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers below 2**32 that only the seed and the doc_id (null: no digits) decide."""
        key = f"{self.seed}:{'' if doc_id is None else doc_id}"
        digest = hashlib.sha256(key.encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]

    def plan(self, doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
        """The form, and after how many units the prefix and the middle end."""
        h1, h2, h3, h4 = self.draws(doc_id)
        if n == 0 or marked or h3 % 100 >= 100 - self.plain:
            return "plain", 0, 0
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return ("spm" if h4 % 100 < self.suffix_first else "psm"), a, b


def unit_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a code point, and which a unit; ``at`` are the first bytes of the texts."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    inner = at[at < len(data)]
    unit[inner] = point[inner]
    return point, unit


def _cuts(point: np.ndarray, a: int, b: int) -> list[int]:
    """Where the frames of a text end: at code points, none longer than ``FRAME``."""
    out = []
    while b - a > FRAME:
        stop = a + FRAME
        while stop > a + 1 and not point[stop]:
            stop -= 1
        out.append(stop)
        a = stop
    return [*out, b] if b > a else out


def store(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """Every document as frames with cumulative counts; ``marked``: a marker occurs in its text.

    A null or empty text has no frames. Rows are kept as often as they come. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column("text"))
                point, unit = unit_starts(data, at[:-1])
                points, units = (np.append(0, np.cumsum(x)) for x in (point, unit))
                raw = data.tobytes()
                ends, counts, frames, marked = [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    stops = _cuts(point, a, b)
                    text = raw[a:b]
                    marked.append(any(m in text for m in rule.markers))
                    frames += [press.compress(raw[x:y]) for x, y in zip([a, *stops], stops)]  # noqa: B905
                    ends += stops
                    counts.append(len(stops))
                list_at = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                base = np.repeat(at[:-1], counts)
                ends = np.array(ends, np.int64)
                lists = [pa.array(units[ends] - units[base]), pa.array(points[ends] - points[base]), pa.array(frames, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(marked, pa.bool_()), *(pa.ListArray.from_arrays(list_at, x) for x in lists)],
                    ["doc_id", "marked", "units", "chars", "frames"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, STORED)


class _Place(NamedTuple):
    frame: int
    byte: int
    chars: int  # code points before the cut, in the whole text


class _Frames:
    """The frames of one document; the last one that was opened is kept."""

    def __init__(self, units: np.ndarray, chars: np.ndarray, data: list[bytes], open_) -> None:
        self.units, self.chars, self.data, self.open, self.last = units, chars, data, open_, (-1, b"")

    def raw(self, k: int) -> bytes:
        if self.last[0] != k:
            self.last = (k, self.open(self.data[k]))
        return self.last[1]

    def place(self, n: int) -> _Place:
        """Where ``n`` units end. Between two frames it is the beginning of the later one."""
        k = int(np.searchsorted(self.units, n, "right"))
        before = (int(self.units[k - 1]), int(self.chars[k - 1])) if k else (0, 0)
        if k == len(self.units):
            return _Place(k, 0, before[1])
        data = np.frombuffer(self.raw(k), np.uint8)
        point, unit = unit_starts(data, np.zeros(1, np.int64))
        starts = np.flatnonzero(unit)
        if len(starts) > self.units[k] - before[0]:  # the first run of letters began in the frame before
            starts = starts[1:]
        byte = int(starts[n - before[0]])
        return _Place(k, byte, before[1] + int(np.count_nonzero(point[:byte])))

    def between(self, a: _Place, b: _Place) -> Iterator[tuple[bool, bytes]]:
        """The text from ``a`` to ``b``: (whether it is a whole frame, its bytes)."""
        for k in range(a.frame, min(b.frame + 1, len(self.data))):
            begin, stop = (a.byte if k == a.frame else 0), (b.byte if k == b.frame else None)
            if begin == 0 and stop is None:
                yield True, self.data[k]
            elif stop is None or stop > begin:
                yield False, self.raw(k)[begin:stop]


def _rows(batch: pa.RecordBatch, open_) -> Iterator[tuple[dict, _Frames]]:
    lists = {c: batch.column(c) for c in ("units", "chars", "frames")}
    at = lists["units"].offsets.to_numpy()
    flat = {c: lists[c].values.to_numpy() for c in ("units", "chars")}
    data = lists["frames"].values
    begin = lists["frames"].offsets.to_numpy()
    for i, (doc_id, marked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), strict=True)):
        span = slice(at[i], at[i + 1])
        frames = data[begin[i] : begin[i + 1]].to_pylist()
        yield {"doc_id": doc_id, "marked": marked}, _Frames(flat["units"][span], flat["chars"][span], frames, open_)


def transform(stored: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """The cut documents: ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``frames``.

    The output is the frames' text in order: prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``),
    each behind its marker, or the text as it is (``plain``: empty texts, texts with a marker in them, and the
    drawn share; their lengths are null). Frames without a cut are not opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for row, doc in _rows(batch, open_):
                n = int(doc.units[-1]) if len(doc.units) else 0
                form, a, b = rule.plan(row["doc_id"], n, row["marked"])
                if form == "plain":
                    rows.append((row["doc_id"], n, form, None, None, doc.data))
                    continue
                start, cut, end, stop = _Place(0, 0, 0), doc.place(a), doc.place(b), _Place(len(doc.data), 0, 0)
                parts = {"p": (rule.prefix, start, cut), "m": (rule.middle, cut, end), "s": (rule.suffix, end, stop)}
                out, open_text = [], []

                def close() -> None:
                    if open_text:
                        out.append(press.compress(b"".join(open_text)))  # noqa: B023
                        open_text.clear()  # noqa: B023

                for name in form:
                    marker, x, y = parts[name]
                    open_text.append(marker)
                    for whole, piece in doc.between(x, y):
                        if whole:
                            close()
                            out.append(piece)
                        else:
                            open_text.append(piece)
                close()
                rows.append((row["doc_id"], n, form, cut.chars, end.chars - cut.chars, out))
            ids, n, forms, p, m, frames = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
            columns = [pa.array(v, k) for v, k in zip((ids, n, forms, p, m, frames), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return stored.mapInArrow(run, OUTPUT)


def _with_text(df: DataFrame, name: str) -> DataFrame:
    """The frames' text as a string column beside the others."""
    names = [c for c in df.columns if c not in ("frames", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [b"".join(map(open_, frames)) for frames in batch.column("frames").to_pylist()]
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], [*names, name])

    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names, "frames").mapInArrow(run, f"{kind}, `{name}` string")


def texts(cut: DataFrame) -> DataFrame:
    """The outputs of ``transform`` as texts: ``output`` in the place of the frames."""
    return _with_text(cut, "output")


def original(stored: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of stored documents."""
    return _with_text(stored.select("doc_id", "frames"), "text")


def restored(frames: list[bytes], form: str, rule: Infill, open_) -> Iterator[bytes]:
    """The pieces of the text that an output was made of, in order, read from the output and its form alone.

    Two passes: the first finds the markers in the stream, the second gives the parts in the order of the text.
    """
    if form == "plain":
        yield from map(open_, frames)
        return
    order = [{"p": rule.prefix, "s": rule.suffix, "m": rule.middle}[c] for c in form]
    found, place, tail, base = [], 0, b"", 0  # each marker is looked for behind the one before it
    for frame in frames:
        window = tail + open_(frame)
        base = place - len(tail)
        at = 0
        while len(found) < 3 and (hit := window.find(order[len(found)], at)) >= 0:
            found.append(base + hit)
            at = hit + len(order[len(found) - 1])
        place = base + len(window)
        keep = max(map(len, order)) - 1
        tail = window[max(at, len(window) - keep) :]
    spans = {}
    for k, name in enumerate(form):
        spans[name] = (found[k] + len(order[k]), found[k + 1] if k < 2 else place)
    for name in "pms":
        a, b = spans[name]
        place = 0
        for frame in frames:
            size = zstandard.frame_content_size(frame)
            if place + size > a and place < b:
                yield open_(frame)[max(0, a - place) : b - place]
            place += size


def digests(cut: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """``transform``'s columns with digests in the place of frames: of the output, and of the text rebuilt from it."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums = ([], [])
            for frames, form in zip(batch.column("frames").to_pylist(), batch.column("form").to_pylist(), strict=True):
                kept = {frames[0]: open_(frames[0])} if len(frames) == 1 else None  # one frame is opened once
                read = kept.__getitem__ if kept else open_
                for out, pieces in zip(sums, (map(read, frames), restored(frames, form, rule, read)), strict=True):
                    digest = hashlib.sha256()
                    for piece in pieces:
                        digest.update(piece)
                    out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], [*names, "output_sha256", "restored_sha256"])

    kind = OUTPUT.replace("frames array<binary>", "output_sha256 string, restored_sha256 string")
    return cut.select(*names, "frames").mapInArrow(run, kind)

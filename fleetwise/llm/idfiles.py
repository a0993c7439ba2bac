"""Token ids of texts in files of Simple-8b words, written in ascending order of doc_id.

**Encoding.** The ids are those that the tokenizer library gives for the whole text. A byte-level vocabulary
is looked up chunk by chunk: a text is cut only where its splitting pattern always ends a match (a
white space behind something else, an ASCII letter or digit before punctuation or the other of the
two, punctuation but the apostrophe before a letter or digit), so the ids of a text are those of its
chunks in a row; every task encodes a distinct chunk once. Texts that hold an added token of the
vocabulary, and all texts under another kind of tokenizer, go to the library whole.

**Files.** Rows are dealt to shards by ranges of doc_id (rows of one doc_id by their text) and sorted; every task
writes one file straight to the shared folder and returns a row on it. A file counts once its row is
in the table of files, so that a repeated or lost task leaves nothing but an unread file. A file is

    segments | index: (offset, ids before, ids, documents) of every segment | offset of the index, segments, ids, magic

and a segment the doc_ids, their lengths, the first word of every block of 256 ids, the escapes and the
words, each an array in little-endian order. So a reader goes to a segment by the index, and in it
to any document by whole blocks, and unpacks all blocks at once (``simple8b``).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwise.llm import simple8b
from fleetwise.llm.kernel import slices, text_bytes
from fleetwise.llm.lexicon import Lexicon
from fleetwise.shared import qualified

MAGIC = b"IDS8"
FOOT = struct.Struct("<QQQ4s")
HEAD = struct.Struct("<QQQQ")  # documents, ids, words, escapes
ROOM = 1 << 19  # chunks that a worker keeps
ASKED = 1 << 13  # chunks that the library encodes at a time
SEGMENT = 1 << 19  # ids after which a segment ends; a document is never parted

FILES = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"

# What a byte may be in a cut.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = ~(_LETTER | _DIGIT)[33:127]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_DARK = np.zeros(256, bool)
_DARK[33:127] = True
_KIND = np.zeros(256, np.uint8)  # letters, digits, signs, other; a cut is between two of the first three
_KIND[_LETTER], _KIND[_DIGIT], _KIND[_SIGN] = 1, 2, 3


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts begin, in bytes; ``at`` are the first bytes of the texts."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        kind, dark = _KIND[data], _DARK[data]
        # the last byte of a character from U+00C0 to U+07FF: none of these is white space
        dark[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        before, here = kind[:-1], kind[1:]
        cut[1:] = (before != here) & (before > 0) & (here > 0) & (data[:-1] != 0x27)
        cut[1:] |= dark[:-1] & _BLANK[data[1:]]
        lone = dark[:-2] & (data[1:-1] == 10) & _DARK[data[2:]]
        cut[2:] |= lone
    cut[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


@dataclass(frozen=True)
class Encoder:
    """A tokenizer's file as text; tasks build it once for each worker."""

    text: str

    @property
    def cuts(self) -> bool:
        """Whether texts may be cut by ``chunk_starts``."""
        model = json.loads(self.text)
        split = model.get("pre_tokenizer") or {}
        return model.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


class _Worker(NamedTuple):
    tokenizer: object
    lexicon: Lexicon | None
    added: tuple[bytes, ...]


_workers: dict[str, _Worker] = {}


def ids_in_parts(tokenizer, words: list[str]) -> list[list[int]]:
    """The ids of all words; the library's own records are larger than the ids and last for one part only."""
    out = []
    for a in range(0, len(words), ASKED):
        out += [e.ids for e in tokenizer.encode_batch_fast(words[a : a + ASKED], add_special_tokens=False)]
    return out


def _worker(encoder: Encoder) -> _Worker:
    if encoder.text not in _workers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(encoder.text)

        def encode(chunks: list[bytes]) -> list[list[int]]:
            return ids_in_parts(tokenizer, [c.decode("utf-8", "replace") for c in chunks])

        added = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())
        _workers.clear()
        _workers[encoder.text] = _Worker(tokenizer, Lexicon(encode, ROOM) if encoder.cuts else None, added)
    return _workers[encoder.text]


def load(path: str) -> Encoder:
    """Read on the driver; tasks get the content, not the path."""
    with open(path, encoding="utf-8") as file:
        return Encoder(file.read())


def _encoded(texts: pa.Array, worker: _Worker) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each has."""
    data, at = text_bytes(texts)
    raw = data.tobytes()
    if worker.lexicon is None or any(a in raw for a in worker.added):
        whole = ["" if t is None else t for t in texts.to_pylist()]
        found = [e.ids for e in worker.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts
    starts = chunk_starts(data, at)
    ids, counts = worker.lexicon.lay_out(data, starts, np.append(starts[1:], len(data)))
    sums = np.append(0, np.cumsum(counts))
    return ids, np.diff(sums[np.searchsorted(starts, at)])


def _batches(parts: Iterator[pa.RecordBatch], encoder: Encoder, end: int | None):
    """Per slice: doc_ids (Arrow), ids, and how many each document has."""
    worker = _worker(encoder)
    for batch in parts:
        for part in slices(batch):
            ids, counts = _encoded(part.column("text"), worker)
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            yield part.column("doc_id"), ids, counts


def encode(docs: DataFrame, encoder: Encoder, end: int | None = None) -> DataFrame:
    """``doc_id`` and ``token_ids`` of every row, the ``end`` id behind each; a null text is empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in _batches(parts, encoder, end):
            at = np.append(0, np.cumsum(counts)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, lists], ["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, token_ids array<int>")


# -- files ---------------------------------------------------------------------------------------


class Segment(NamedTuple):
    """Some documents in a row: their keys (Arrow, with nulls), where each ends, and the packed ids."""

    keys: pa.Array
    stops: np.ndarray
    packed: simple8b.Packed

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the documents ``first`` to ``last``, read from their blocks alone."""
        last = len(self.stops) if last is None else last
        a = int(self.stops[first - 1]) if first else 0
        b = int(self.stops[last - 1]) if last else 0
        block = a // simple8b.BLOCK
        found = simple8b.unpack(self.packed, int(self.stops[-1]) if len(self.stops) else 0, block, -(-b // simple8b.BLOCK))
        return found[a - block * simple8b.BLOCK :][: b - a]


def segment_bytes(keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    packed = simple8b.pack(ids)
    known = np.asarray(keys.is_valid(), np.uint8)
    numbers = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    head = HEAD.pack(len(counts), len(ids), len(packed.words), len(packed.escapes))
    parts = (numbers, counts.astype("<u8"), packed.escapes.astype("<u8"), packed.words.astype("<u8"), packed.begins.astype("<u4"), known)
    return head + b"".join(p.tobytes() for p in parts)


def read_segment(raw: bytes) -> Segment:
    docs, ids, words, escapes = HEAD.unpack_from(raw)
    place = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(raw, kind, n, place)
        place += out.nbytes
        return out

    numbers, counts, outside, packed = take("<i8", docs), take("<u8", docs), take("<u8", escapes), take("<u8", words)
    begins, known = take("<u4", -(-ids // simple8b.BLOCK) + 1), take("u1", docs)
    keys = pa.array(numbers, mask=known == 0)
    return Segment(keys, np.cumsum(counts.astype(np.int64)), simple8b.Packed(packed, begins, outside))


class _Writer:
    """One file of a shard."""

    def __init__(self, folder: str, shard: int) -> None:
        import uuid

        self.name = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.ids"
        system, path = fs.FileSystem.from_uri(self.name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.index, self.bytes, self.ids, self.docs = system.open_output_stream(path), [], 0, 0, 0
        self.open: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.open.append((keys, counts, ids))
        self.pending += len(ids)
        if self.pending >= SEGMENT:
            self.flush()

    def flush(self) -> None:
        if not self.open:
            return
        keys, counts, ids = zip(*self.open, strict=True)
        counts = np.concatenate(counts)
        raw = segment_bytes(pa.concat_arrays(keys), counts, np.concatenate(ids))
        self.index.append((self.bytes, self.ids, self.pending, len(counts)))
        self.out.write(raw)
        self.bytes, self.ids, self.docs = self.bytes + len(raw), self.ids + self.pending, self.docs + len(counts)
        self.open, self.pending = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, "<i8").tobytes()
        self.out.write(index + FOOT.pack(self.bytes, len(self.index), self.ids, MAGIC))
        self.out.close()
        self.bytes += len(index) + FOOT.size


def write_ids(docs: DataFrame, encoder: Encoder, folder: str, end: int | None = None) -> DataFrame:
    """Write the ids of all rows to files in ``folder`` and return the table of files.

    Documents are in ascending order of doc_id over all files, those without one first; of rows with one
    doc_id, by a hash of the text. A null text has no ids but the ``end`` id, which is put behind every
    document where it is given. Equal rows are written as often as they come. No rows: no files. Other
    columns are not looked at. ``folder`` must be reachable from every executor. The frame is lazy: store
    it (``kept``) before reading the files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    tie = F.xxhash64("text")
    dealt = rows.withColumn("tie", tie).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        for keys, ids, counts in _batches(parts, encoder, end):
            writer = writer or _Writer(folder, shard)
            writer.add(keys, ids, counts)
        if writer:
            writer.close()
            row = (shard, writer.name, writer.docs, writer.ids, writer.bytes)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shard", "path", "n_docs", "n_ids", "n_bytes"])

    return dealt.mapInArrow(run, FILES)


def segments(path: str, first_id: int = 0) -> Iterator[tuple[int, Segment]]:
    """The segments of a file that hold ids from number ``first_id`` on, and how many ids come before each."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        size = file.size()
        file.seek(size - FOOT.size)
        offset, n, _, magic = FOOT.unpack(file.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of ids")
        file.seek(offset)
        index = np.frombuffer(file.read(n * 32), "<i8").reshape(n, 4)
        ends = np.append(index[1:, 0], offset)
        for (at, before, ids, _), stop in zip(index.tolist(), ends.tolist(), strict=True):
            if before + ids > first_id:
                file.seek(at)
                yield before, read_segment(file.read(stop - at))


def _read(files: DataFrame, make, kind: str) -> DataFrame:
    """One task for each file; ``start`` counts the ids of all files before it (a window over files, not documents)."""
    spark: SparkSession = files.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, files.count())
    placed = placed.repartitionByRange(n, "shard") if n > 1 else placed

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.select(["path", "base"]).to_pylist():
                for ahead, segment in segments(row["path"]):
                    ids = segment.ids().astype("<u4")
                    stops = segment.stops
                    begins = np.append(0, stops[:-1])
                    names, columns = make(ids, begins, stops)
                    yield pa.RecordBatch.from_arrays([segment.keys, pa.array(begins + (ahead + row["base"])), *columns], ["doc_id", "start", *names])

    assert spark is not None
    return placed.mapInArrow(run, f"doc_id bigint, start bigint, {kind}")


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``token_ids`` of every document in the files."""

    def make(ids, begins, stops):
        at = pa.array(np.append(0, stops).astype(np.int32))
        return ["token_ids"], [pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int64)))]

    return _read(files, make, "token_ids array<bigint>")


def digests(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as unsigned little-endian 32-bit numbers)."""

    def make(ids, begins, stops):
        raw = memoryview(ids.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        return ["n_tokens", "ids_crc32"], [pa.array(stops - begins), pa.array(sums, pa.int64())]

    return _read(files, make, "n_tokens bigint, ids_crc32 bigint")

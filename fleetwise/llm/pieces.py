"""Encoding texts with a vocabulary of scored pieces, and decoding them.

A text is marked as usual (a mark in front, every blank becomes a mark). Where two characters meet that no
piece has side by side, no piece reaches across, so the text falls apart there: the best segmentation
of a text is the best one of each of these words. The score of a segmentation is the sum of its
pieces' scores; characters without a piece become bytes.

A task gathers the distinct words of a slice that it has not met before, sorts them and walks the trie they form
depth-first: what the forward pass has found for a common beginning stays on the stack and
serves the next word. The ids of all words are then laid out at once (``lexicon``). No shuffle, and no
table that grows with the corpus.

The vocabulary in use here was made by pair merging, and its scores are the negative merge ranks. The
best sum of scores is what the method names; a merging encoder may cut some words otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import slices, text_bytes
from fleetwise.llm.lexicon import Lexicon

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")  # the words of a marked text
ROOM = 1 << 17  # words that a worker keeps
PART = 1 << 18  # ids that are decoded at once, or one row's
INFINITE = float("inf")


@dataclass(frozen=True)
class Vocabulary:
    """Piece to (score, id); what ids stand for; ids of the 256 bytes (None without fallback)."""

    scores: dict[str, tuple[float, int]]
    bytes_of: list[bytes]
    byte_ids: list[int] | None
    unknown: int

    @cached_property
    def pieces(self) -> dict[str, tuple[float, tuple[int, ...]]]:
        """``scores`` with the ids as tuples, to be strung together."""
        return {p: (s, (i,)) for p, (s, i) in self.scores.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)

    @cached_property
    def floor(self) -> float:
        """The score of a character that has no piece."""
        return min((s for s, _ in self.scores.values()), default=0.0) - 10.0

    @cached_property
    def apart(self) -> np.ndarray:
        """128 x 128: whether no piece has the two ASCII characters (the mark is a blank) side by side."""
        out = np.ones((128, 128), bool)
        for piece in self.scores:
            text = piece.replace(MARK, " ")
            for x, y in zip(text, text[1:]):  # noqa: B905
                if x < "\x80" and y < "\x80":
                    out[ord(x), ord(y)] = False
        return out

    @cached_property
    def mark_leads(self) -> bool:
        """Whether no piece has a mark behind another character, so that a word ends before each."""
        return not any(MARK in piece.lstrip(MARK) for piece in self.scores)

    @cached_property
    def key(self) -> str:
        """What tells vocabularies apart."""
        told = repr((sorted(self.scores.items()), self.byte_ids, self.unknown))
        return hashlib.sha256(told.encode()).hexdigest()

    def spell(self, char: str) -> tuple[int, ...]:
        if self.byte_ids is None:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in char.encode())


def load(path: str) -> Vocabulary:
    """Read a model file on the driver; tasks get the vocabulary, not the path."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores, bytes_of, byte_ids = {}, [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
        elif model.is_control(i) or model.is_unused(i):
            bytes_of.append(b"")
        elif model.is_unknown(i):
            bytes_of.append(" ⁇ ".encode())
        else:
            scores[piece] = (model.get_score(i), i)
            bytes_of.append(piece.replace(MARK, " ").encode())
    return Vocabulary(scores, bytes_of, byte_ids if min(byte_ids) >= 0 else None, model.unk_id())


def mark(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def segment(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """The ids of the best pieces of every word; of equal sums the one with the longer last piece."""
    get, longest, floor = vocabulary.pieces.get, vocabulary.longest, vocabulary.floor
    out: dict[str, list[int]] = {}
    last = ""
    best, cut, ids = [0.0], [0], [()]  # the stack: one entry for each character of the path
    for word in sorted(words):
        depth = 0
        for a, b in zip(last, word):  # noqa: B905
            if a != b:
                break
            depth += 1
        del best[depth + 1 :], cut[depth + 1 :], ids[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            top, at, own = -INFINITE, 0, ()
            for begin in range(end - longest if end > longest else 0, end):
                found = get(word[begin:end])
                if found is not None:
                    total = best[begin] + found[0]
                    if total > top:
                        top, at, own = total, begin, found[1]
            if found is None:  # the last character alone is no piece
                total = best[end - 1] + floor
                if total > top:
                    top, at, own = total, end - 1, vocabulary.spell(word[end - 1])
            best.append(top)
            cut.append(at)
            ids.append(own)
        end = cut[-1]
        path = list(reversed(ids[-1]))
        while end:
            path += reversed(ids[end])
            end = cut[end]
        path.reverse()
        out[word] = path
        last = word
    return out


def lexicon_of(vocabulary: Vocabulary) -> Lexicon:
    """Words (UTF-8, a blank for a mark) to ids."""

    def ids_of(chunks: list[bytes]) -> list[list[int]]:
        words = [c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks]
        found = segment(set(words), vocabulary)
        return [found[w] for w in words]

    return Lexicon(ids_of, ROOM)


_workers: dict[str, tuple[Vocabulary, Lexicon]] = {}  # a worker's words serve its next task


def marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, those with text behind a blank of their own, and where each begins; a mark is a blank."""
    data, at = text_bytes(texts)
    if MARK.encode() in data.tobytes():
        data, at = text_bytes(pc.replace_substring(texts, MARK, " "))
    some = np.flatnonzero(np.diff(at))
    begins = np.append(0, np.cumsum(np.diff(at) + (np.diff(at) > 0)))
    return np.insert(data, at[some], 32), begins


def word_starts(data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Where the words of the texts begin, in bytes."""
    cut = np.zeros(len(data), bool)
    if len(data):
        low = data < 128
        cut[1:] = low[1:] & low[:-1]
        cut[1:] &= vocabulary.apart[data[:-1] & 127, data[1:] & 127]
        if vocabulary.mark_leads:
            cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
    cut[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``text`` and ``token_ids`` for every row.

    A null or empty text has no tokens. Whole texts are encoded, whatever their length, in time that grows with
    it, unbroken words included. Other columns are not looked at; a ``token_ids`` among them is not carried on.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key
    names = [c for c in dict.fromkeys((*keep, "text")) if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = shared.value, lexicon_of(shared.value)
        vocabulary, lexicon = _workers[key]
        for batch in batches:
            for part in slices(batch):
                data, at = marked(part.column("text"))
                starts = word_starts(data, at, vocabulary)
                ids, counts = lexicon.lay_out(data, starts, np.append(starts[1:], len(data))[: len(starts)])
                stops = np.append(0, np.cumsum(counts))[np.searchsorted(starts, at)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "token_ids"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{kind}, token_ids array<int>")


def joined(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The texts that lists of ids stand for; a null list is null, bytes that are no text become question marks."""
    begins = lists.offsets.to_numpy()
    if not len(lists):
        return pa.array([], pa.string())
    ids = lists.values.slice(begins[0], begins[-1] - begins[0])
    texts = pa.ListArray.from_arrays(pa.array(begins - begins[0]), pieces.take(ids))
    raw = pc.binary_join(texts, pa.scalar(b""))
    if lists.null_count:
        raw = pc.if_else(lists.is_valid(), raw, pa.scalar(None, pa.binary()))
    raw = pc.if_else(pc.starts_with(raw, b" "), pc.binary_replace_slice(raw, 0, 1, b""), raw)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded``, read from ``token_ids``; null ids give null.

    Decoding undoes encoding exactly, except that the mark character itself comes back as a blank.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.bytes_of)
    names = [c for c in dict.fromkeys((*keep, "token_ids")) if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.binary())
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column("token_ids")), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PART)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), joined(part.column("token_ids"), pieces)], [*names, "decoded"])

    kind = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return encoded.select(*names).mapInArrow(run, f"{kind}, decoded string")


def encoded_and_back(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``token_ids``, ``n_tokens``, ``restored``: whether decoding gave the text back."""
    both = decode(encode(docs, vocabulary), vocabulary, keep=("doc_id", "text"))
    same = F.translate(F.coalesce("text", F.lit("")), MARK, " ") == F.col("decoded")
    return both.select("doc_id", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"), same.alias("restored"))

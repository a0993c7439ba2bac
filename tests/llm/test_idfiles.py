import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetwise.llm import idfiles, simple8b
from fleetwise.llm.queries import BYTE_PAIRS, END_ID
from fleetwise.shared import kept, new_path, scope


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_PAIRS)


@pytest.fixture(scope="module")
def encoder():
    return idfiles.load(BYTE_PAIRS)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def told(spark, df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


# -- words ---------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=900))
def test_numbers_come_back(numbers):
    x = np.array(numbers, np.uint64)
    packed = simple8b.pack(x)
    assert (simple8b.unpack(packed, len(x)) == x).all()
    for block in range(len(packed.begins) - 1):
        assert (simple8b.unpack(packed, len(x), block, block + 1) == x[256 * block : 256 * (block + 1)]).all()


def test_small_numbers_take_little_room():
    assert len(simple8b.pack(np.zeros(2560, np.uint64)).words) == 10 * 5  # 60 in a word, 256 in a block
    assert len(simple8b.pack(np.full(256, 2**15 - 1, np.uint64)).words) == 64
    assert len(simple8b.pack(np.full(256, 2**60, np.uint64)).escapes) == 256


# -- ids -----------------------------------------------------------------------------------------

PARTS = ["a", "Zed", "dog's", "'s", "'ll", "'", "12", "٣", "½", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "​", "é", "ß", "日本", "😀", "́", ",", "...", "!?", "<|endoftext|>", "<|", "\x00", "_", "×"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(codec="utf-8")), max_size=25).map("".join), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    library, worker = Tokenizer.from_file(BYTE_PAIRS) if not _library else _library[0], idfiles._worker(_encoder())
    _library[:] = [library]
    ids, counts = idfiles._encoded(pa.array(texts, pa.string()), worker)
    assert [ids[b - n : b].tolist() for b, n in zip(np.cumsum(counts), counts, strict=True)] == [whole(library, t) for t in texts]


_library = []
_read = {}


def _encoder():
    return _read.setdefault(0, idfiles.load(BYTE_PAIRS))


def test_forgetting_chunks(library, encoder, monkeypatch):
    monkeypatch.setattr(idfiles, "ROOM", 3)
    idfiles._workers.clear()
    rng = random.Random(2)
    worker = idfiles._worker(encoder)
    for _ in range(20):
        texts = [" ".join(rng.choice(PARTS) + str(rng.randrange(99)) for _ in range(30)), "y" * 700]
        ids, counts = idfiles._encoded(pa.array(texts), worker)
        assert ids.tolist() == [i for t in texts for i in whole(library, t)]


def test_another_kind_of_tokenizer_sees_whole_texts():
    encoder = idfiles.load(BYTE_PAIRS.replace("byte_bpe_50k", "word_bpe_49k"))
    assert not encoder.cuts
    texts = ["Some Words, don't  split\nthem", "", None]
    ids, counts = idfiles._encoded(pa.array(texts), idfiles._worker(encoder))
    other = Tokenizer.from_file(BYTE_PAIRS.replace("byte_bpe_50k", "word_bpe_49k"))
    assert ids.tolist() == [i for t in texts for i in whole(other, t)] and counts[2] == 0


# -- files ---------------------------------------------------------------------------------------


def written(spark, rows, encoder, end=END_ID):
    folder = new_path(spark, "ids")
    return kept(idfiles.write_ids(documents(spark, rows), encoder, folder, end), "files")


def test_awkward_rows(spark, library, encoder):
    rows = [*AWKWARD, *[(i, f"text {i} " * (i % 7)) for i in range(-50, 300)], (17, "another text 17"), (400, "end <|endoftext|> of text")]
    with scope():
        files = written(spark, rows, encoder)
        got, ids = told(spark, idfiles.digests(files)), told(spark, idfiles.read_ids(files))
        assert files.agg({"n_docs": "sum"}).first()[0] == len(rows)
    want = sorted(((i, [*whole(library, t), END_ID]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in want]
    place = 0
    for (doc_id, start, n, crc), (_, _, tokens) in zip(got, ids, strict=True):
        assert start == place and n == len(tokens)
        assert crc == zlib.crc32(np.array(tokens, "<u4").tobytes())
        place += n
    assert sorted(((i, list(t)) for i, _, t in ids), key=repr) == sorted(want, key=repr)


def test_encode_alone(spark, library, encoder):
    rows = [(1, "one text"), (2, None), (3, "")]
    got = {r.doc_id: r.token_ids for r in idfiles.encode(documents(spark, rows), encoder).collect()}
    assert got == {1: whole(library, "one text"), 2: [], 3: []}


def test_segments_are_read_alone(spark, encoder, monkeypatch):
    keys = pa.array([5, None, 7], pa.int64())
    counts = np.array([700, 0, 300])
    ids = np.arange(1000)
    segment = idfiles.read_segment(idfiles.segment_bytes(keys, counts, ids))
    assert segment.keys.to_pylist() == [5, None, 7]
    assert segment.ids(0, 1).tolist() == list(range(700)) and segment.ids(1, 2).tolist() == []
    assert segment.ids(2, 3).tolist() == list(range(700, 1000))


def test_a_file_of_several_segments(spark, library, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(idfiles, "SEGMENT", 50)
    writer = idfiles._Writer(f"file://{tmp_path}", 3)
    for k in range(9):
        writer.add(pa.array([2 * k, 2 * k + 1]), np.arange(40 * k, 40 * k + 40), np.array([25, 15]))
    writer.close()
    parts = list(idfiles.segments(writer.name))
    assert [p[0] for p in parts] == [0, 80, 160, 240, 320] and writer.ids == 360 and writer.docs == 18
    assert np.concatenate([s.ids() for _, s in parts]).tolist() == list(range(360))
    assert [p[0] for p in idfiles.segments(writer.name, 200)] == [160, 240, 320]
    (tmp_path / "other").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="no file of ids"):
        list(idfiles.segments(f"file://{tmp_path}/other"))


def test_empty_table(spark, encoder):
    with scope():
        files = written(spark, [], encoder)
        assert files.collect() == [] and idfiles.digests(files).collect() == []

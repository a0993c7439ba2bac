import random

import pytest
from cases import AWKWARD, documents
from sentencepiece import SentencePieceProcessor

from fleetwise.llm import pieces
from fleetwise.llm.queries import PIECES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def best_sum(text, vocabulary):
    """The largest sum over all ways to cut a text, from the front, with nothing shared."""
    known = {len(text): 0.0}
    for i in range(len(text) - 1, -1, -1):
        ends = [(vocabulary.scores[text[i:j]][0] + known[j]) for j in range(i + 1, len(text) + 1) if text[i:j] in vocabulary.scores]
        known[i] = max(ends + ([vocabulary.floor + known[i + 1]] if text[i] not in vocabulary.scores else []))
    return known[0]


def test_no_segmentation_has_a_larger_sum(vocabulary):
    rng = random.Random(1)
    known = [p.replace(pieces.MARK, "") for p in vocabulary.scores if p.isascii() and len(p) > 1]
    words = {"".join(rng.choice(known) for _ in range(rng.randrange(1, 5))) for _ in range(2000)}
    words |= {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(2000)}
    words |= {"日本語", "\x00", "é\u0301", "a\U0001f9d9b"}
    got = pieces.segment({pieces.mark(w) for w in words if w}, vocabulary)
    score_of = {i: s for s, i in vocabulary.scores.values()}
    for w, ids in got.items():
        unknown = sum(c not in vocabulary.scores for c in w)
        assert sum(score_of.get(i, 0.0) for i in ids) + unknown * vocabulary.floor == best_sum(w, vocabulary), w
    model = SentencePieceProcessor(model_file=PIECES)
    assert all(model.decode(list(ids)) == w[1:] for w, ids in got.items())


def test_sharing_beginnings_changes_nothing(vocabulary):
    words = {pieces.mark(w) for w in ("", "a", "ab", "abc", "abcd", "abd", "b", "the", "then", "thenx", "日本", "日", "é", "e\u0301")} - {""}
    together = pieces.segment(words, vocabulary)
    for w in words:
        assert pieces.segment([w], vocabulary)[w] == together[w]


def test_round_trip_of_awkward_texts(spark, vocabulary):
    rows = [*AWKWARD, (1, " a  b "), (2, "  "), (3, "<0x0A> <s> </s> <unk>"), (4, "tab\tnew\nline\r\n"), (5, "a▁b"), (6, "\U0001f9d9\u200d" * 50)]
    got = pieces.encoded_and_back(documents(spark, rows), vocabulary).collect()
    assert len(got) == len(rows) and all(r.restored for r in got)
    assert all((r.n_tokens == 0) == (not r.token_ids) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[9001] == 0
    twice = [tuple(r.token_ids) for r in got if r.doc_id == 9008]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_decoding_other_ids(spark, vocabulary):
    frame = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [])], "doc_id bigint, token_ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(frame, vocabulary).collect()} == {1: "", 2: None, 3: ""}


def whole_text(text, vocabulary):
    """The best cut of a whole marked text by the same rule, nothing shared and nothing cut beforehand."""
    return pieces.segment([pieces.mark(text)], vocabulary)[pieces.mark(text)] if text else []


def test_words_are_cut_where_no_piece_reaches(spark, vocabulary):
    rng = random.Random(7)
    signs = "ab e,.-'(\n\t0123é▁日_\x00<0x0A>"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(300)] + AWKWARD[2:9]
    got = {r.doc_id: list(r.token_ids) for r in pieces.encode(documents(spark, rows), vocabulary).collect()}
    for i, text in rows:
        want = whole_text(text, vocabulary)
        assert got[i] == want, text


def test_forgetting_words(vocabulary, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(pieces, "ROOM", 3)
    found = pieces.lexicon_of(vocabulary)
    for k in range(20):
        texts = [f"word{k} common word{k + 1}", None, "z" * 600]
        data, at = pieces.marked(pa.array(texts))
        starts = pieces.word_starts(data, at, vocabulary)
        ids, counts = found.lay_out(data, starts, np.append(starts[1:], len(data)))
        assert ids.tolist() == [i for t in texts for i in whole_text(t, vocabulary)]


def test_one_word_of_a_million_characters(vocabulary):
    import time

    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    began = time.perf_counter()
    ids = pieces.segment([word], vocabulary)[word]
    assert time.perf_counter() - began < 20
    assert b"".join(vocabulary.bytes_of[i] for i in ids).decode() == word


def test_empty_table(spark, vocabulary):
    assert pieces.encode(documents(spark, []), vocabulary).collect() == []

import random
import re
import zlib

import pytest
from cases import AWKWARD, documents, edited, sentence

from fleetwise.llm import jaccard
from fleetwise.llm.components import components

WORD = re.compile("[^ \t-\r]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        out.append((doc, grams))
    return out


def brute(rows, rule):
    sets = sets_of(rows, rule.words)
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and rule.den * len(s & t) >= rule.num * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(30):
        base = sentence(rng, rng.choice([4, 12, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((doc := doc + rng.randrange(1, 5), edited(rng, base, rng.choice([0, 0, 1, 2, 5, 12]))))
        chain = base
        for _ in range(rng.choice([0, 5])):  # every link holds, the ends do not
            chain = edited(rng, chain, 1)
            rows.append((doc := doc + 1, chain))
    shared = sentence(rng, 60)
    for _ in range(25):  # a passage that many share, and a group of copies of copies
        rows.append((doc := doc + 1, sentence(rng, 120) + " " + shared))
    base = sentence(rng, 100)
    rows += [(doc + 1 + i, edited(rng, base, 1)) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [jaccard.Similarity(3, 9, 10), jaccard.Similarity(5, 4, 5, counters=8)])
def test_groups_are_those_of_all_pairs(spark, rule):
    rows = near_copies(rule.words) + AWKWARD
    got = jaccard.similarity_groups(documents(spark, rows), rule)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, rule)


def test_rows_of_one_doc_id_are_one_document(spark):
    rng = random.Random(12)
    t1, t2, t3, t4 = (sentence(rng, 40) for _ in range(4))
    rows = [(1, t2), (5, t1), (5, t2), (9, t1), (9, t3), (20, t3), (20, ""), (30, t4), (30, None), (31, edited(rng, t4, 1)), (40, ""), (40, ""), (None, t1), (None, "")]
    rule = jaccard.Similarity(3, 7, 10)
    got = sorted((tuple(r) for r in jaccard.similarity_groups(documents(spark, rows), rule).collect()), key=str)
    assert got == brute(rows, rule)
    assert {r[2] for r in got if r[0] in (1, 5, 9, 20)} == {1}


def test_full_bit_tables_lose_nothing(spark, monkeypatch):
    """Tables of 32 bits are full at once: then everything passes, as without them."""
    for name in ("KEY_BITS", "GRAM_BITS", "ID_BITS"):
        monkeypatch.setattr(jaccard, name, 5)
    rows = near_copies(8) + AWKWARD
    rule = jaccard.Similarity(3, 9, 10)
    got = jaccard.similarity_groups(documents(spark, rows), rule)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, rule)


def test_empty_table(spark):
    assert jaccard.similarity_groups(documents(spark, [])).collect() == []


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, 1000 + i) for i in range(50)]
    edges = [*path, *star, (7, 7), (8, 9), (9, 8), (None, 3), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(100, 161)} | {1000 + i: 5 for i in range(50)} | {5: 5, 8: 8, 9: 8}
    assert got == want


def test_near_copies_cost_no_square(spark):
    """A group of many near copies of one text is compared with its leaders only."""
    rng = random.Random(3)
    base = sentence(rng, 150)
    rows = [(0, base)] + [(i, edited(rng, base, 1)) for i in range(1, 400)]
    seen = []
    real = jaccard._possible

    def counting(pairs, classes, rule):
        seen.append(pairs.count())
        return real(pairs, classes, rule)

    jaccard._possible = counting
    try:
        got = jaccard.similarity_groups(documents(spark, rows), jaccard.Similarity(3, 9, 10)).collect()
    finally:
        jaccard._possible = real
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 20 * len(rows)


def test_verification_moves_compressed_texts_once_for_each_document(spark):
    """Two 64-bit sets a pair, dealt three times over, were most of what the join shuffled."""
    rng = random.Random(4)
    base = sentence(rng, 600)
    rows = [(i, edited(rng, base, 1)) for i in range(20)] * 3 + [(50, None), (51, ""), (52, "Ünïcode wörds\x0bhere 😀 and more")]
    docs = documents(spark, rows)
    ids = spark.createDataFrame([(i,) for i in [*range(20), 50, 51, 52]], "id bigint")
    got = jaccard._texts(docs, ids).collect()
    assert sorted((r.id, zlib.decompress(r.text).decode()) for r in got) == sorted({(i, t or "") for i, t in rows})
    grams = sum(len(s) for _, s in sets_of([(i, t) for i, t in rows[:20]], 3))
    assert sum(len(r.text) for r in got if r.id < 20) < 8 * grams / 1.5


def test_pairs_are_verified_by_all_texts_of_a_document(spark):
    a, b, c = ("one two three four five six seven eight nine ten" + end for end in ("", " eleven", " or so it is said by some"))
    docs = documents(spark, [(1, a), (1, c), (2, b), (2, b), (3, "else"), (4, None)])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a bigint, b bigint")
    got = jaccard._verified(pairs, docs, jaccard.Similarity(3, 8, 10)).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]

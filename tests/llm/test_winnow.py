import random
import re

import pytest
from cases import AWKWARD, documents, sentence, with_clashes

from fleetwise.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [False, True])
def test_same_as_comparing_all_windows(spark, short):
    rng = random.Random(short)
    items = [(i, sentence(rng, rng.randrange(10, 40))) for i in range(12)] + [(20, None), (21, ""), (22, "?!"), (None, sentence(rng, 15)), (3, sentence(rng, 12))]
    items += [(23, items[0][1]), (24, items[0][1][:60])]
    if short:
        items += [(30, "alpha"), (31, "two words"), (32, " ".join(f"s{i}" for i in range(9)))]
    docs = list(AWKWARD)
    for i in range(60):
        w = sentence(rng, 80).split(" ")
        text = items[rng.randrange(12)][1].split(" ")
        n = rng.choice([5, 9, 10, 11, len(text)])
        at = rng.randrange(80)
        joint = rng.choice([" ", ", ", "\n", " -- "])
        docs.append((i, joint.join(w[:at] + [x.upper() for x in text[:n]] + w[at:])))
    docs += [(100, "has alpha once and two, words"), (101, "s0 s1 s2 s3 s4 s5 s6 s7 s8"), (102, items[0][1]), (102, items[0][1])]
    table = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))
    got = winnow.decontaminate(documents(spark, docs), table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items, 10)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)


def test_every_shared_span_leaves_a_shared_print(spark):
    rng = random.Random(9)
    rule = winnow.Windows()
    rows = []
    for i in range(200):
        span = sentence(rng, 10)
        rows += [(2 * i, sentence(rng, 15) + " " + span), (2 * i + 1, span + " " + sentence(rng, 7))]
    prints = (
        winnow._hashed(spark.createDataFrame(rows, "doc_id bigint, text string"))
        .withColumn("grams", winnow._runs("hashes", rule.gram))
        .select("doc_id", winnow._smallest("grams", rule.window - rule.gram + 1).alias("p"))
    )
    found = {r.doc_id: set(r.p) for r in prints.collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(200))


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, 20)) for i in range(5)]
    docs = [(i, sentence(rng, 30) + " " + items[i % 5][1]) for i in range(10)] + [(50, sentence(rng, 40))]
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnow.decontaminate(documents(spark, docs), table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert winnow.decontaminate(documents(spark, []), none).collect() == []
    assert [r.n_hit for r in winnow.decontaminate(documents(spark, [(1, "a b c")]), none).collect()] == [0]

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD, documents, sentence
from pyspark.sql import functions as F

from fleetwise.llm import ppm


class Reference:
    """The same model, read off plain dictionaries, one byte at a time."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            data = b"\xff" * order + (t or "").encode() + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[i - k : i]][data[i]] += 1

    def cost(self, context, byte):
        out, barred = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.after.get(context[len(context) - k :])
            if not seen:
                continue
            left = {b: c for b, c in seen.items() if b not in barred}
            total = sum(left.values())
            if byte in left:
                return out + math.log10((2 * left[byte] - 1) / (2 * total))
            if left:
                out += math.log10(len(left) / (2 * total))
            barred = set(seen)
        return out - math.log10(256 - len(barred))

    def score(self, text):
        data = b"\xff" * self.order + (text or "").encode() + b"\xff"
        return sum(self.cost(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def base(rows, train):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall("[^ \t-\r]+", (t or "").translate(low))
    counts = Counter()
    for doc, text in rows:
        if train(doc):
            counts.update([*cut(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        tokens = [*cut(text), None]
        out.append((doc, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    return [(i, sentence(rng, rng.randrange(1, 60), 40)) for i in range(40)] + [r for r in AWKWARD if r[0] is not None]


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("bound", [10**6, 0])
def test_same_as_the_reference_both_ways(spark, order, bound, monkeypatch):
    if bound == 0:
        monkeypatch.setattr(ppm, "BLOCK_BYTES", 100_000)
    rows = rows_of(order)
    train = lambda d: d % 3 != 0
    got = ppm.score_texts(documents(spark, rows), F.col("doc_id") % 3 != 0, ppm.Settings(order, bound)).collect()
    model = Reference([t for d, t in rows if train(d)], order)
    want = sorted((*b, model.score(t)) for b, (_, t) in zip(base(rows, train), rows, strict=True))
    have = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    for h, w in zip(have, want, strict=True):
        assert h[4:] == pytest.approx(w[4:], rel=1e-9)


def test_bytes_of_a_context_share_one(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 30, 20) for _ in range(10)]
    model = Reference(texts, 3)
    runs, _ = ppm.byte_runs(pa.array(texts), 3)
    keys, n = np.unique(runs, return_counts=True)
    pairs = np.bincount((runs & np.uint64(65535)).astype(int), minlength=65536)
    for context in (b"w1 ", b" w1", b"\xff\xff\xff", b"zzz", b"zz "):
        ask = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        every = np.unique(np.concatenate([keys, ask]))
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, keys)] = n
        cost = ppm.run_costs(every, counts, pairs, 3)[np.searchsorted(every, ask)]
        assert (10**cost).sum() == pytest.approx(1)
        assert cost[119] == pytest.approx(model.cost(context, 119))


def test_nothing_to_learn_from(spark):
    got = ppm.score_texts(documents(spark, [(1, "ab"), (2, None), (None, "x")]), F.lit(False)).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(1, round(-3 * math.log10(256), 9)), (2, round(-math.log10(256), 9)), (None, round(-2 * math.log10(256), 9))}
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert ppm.score_texts(documents(spark, []), F.lit(True)).collect() == []


def test_likely_texts_score_higher(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 50, 30)) for i in range(60)]
    odd = "".join(rng.choice("qxzjkv") for _ in range(150))
    got = {r.doc_id: r for r in ppm.score_texts(documents(spark, [*rows, (100, odd)]), F.col("doc_id") < 50).collect()}
    per_byte = lambda i, t: got[i].score / (len(t) + 1)
    assert all(per_byte(i, t) > 3 * per_byte(100, odd) for i, t in rows)

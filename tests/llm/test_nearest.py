import math
import random

from cases import with_clashes

from fleetwise.llm import nearest


def brute(rows, step, k):
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, u in sorted(whole):
        if q % step == 0:
            hits = {(-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in whole if i != q and len(u) == len(v)}
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(hits)[:k])]
    return out


def run(spark, rows, step=5, **settings):
    table = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    vectors = nearest.integer_vectors(table)
    got = nearest.top_inner_products(vectors, vectors.where(f"vec_id % {step} = 0"), nearest.Settings(**settings))
    return sorted(tuple(r) for r in got.collect())


def test_same_as_all_products(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    same = [0.5] * 6
    rows += [(i, same) for i in range(300, 420)]  # ties of the whole vector
    rows += [(i, [float(rng.randrange(-2, 3)) for _ in range(6)]) for i in range(420, 520)]  # many equal scores
    rows += [(520, None), (525, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (530, [float("nan")] * 6), (535, [float("inf")] + [0.0] * 5), (None, same), (540, []), (545, []), (550, [1.0, 2.0]), (555, same), (555, same)]
    got = run(spark, rows, shard_rows=90, block_rows=40, leaf_rows=8)
    assert got == brute(rows, 5, 5)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-(2**40), 2**40)) for _ in range(3)]) for i in range(60)]
    want = [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in brute(rows, 5, 3)]
    got = run(spark, rows, k=3, leaf_rows=4)
    assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in want]


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]) == [(0, 1, 1, 256 * 128)]
    assert run(spark, []) == []


def test_a_good_floor_closes_boxes():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(c, 0.05, (200, 4)) for c in (-3, 0, 3)])
    tree = nearest.build(np.arange(600), rows, 16)
    query = np.array([[1.0, 1, 1, 1]])
    best = sorted((rows @ query[0]).round(12))[::-1][:3]
    found = nearest.search(tree, [-1], query, [None], 3)
    assert len(found) == 3 and {int(s) for _, _, s in found} == {int(b) for b in best}
    assert nearest.search(tree, [-1], query, [1e9], 3) == []

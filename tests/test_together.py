"""Independent fits run at the same time, and tables of the smaller size are fitted by model."""

import threading

import pytest
from pyspark.sql import functions as F

from fleetwise.learn import boosting as bo
from fleetwise.learn import contenders as ct
from fleetwise.learn import training as tr
from fleetwise.shared import exists, new_path, scope, together


def test_calls_run_at_once_within_the_scopes(spark):
    meet = threading.Barrier(3, timeout=60)

    def call(k):
        meet.wait()
        path = new_path(spark, "met")
        spark.range(k).write.parquet(path)
        return path

    with scope():
        paths = together([lambda k=k: call(k) for k in (1, 2, 3)])
        assert [spark.read.parquet(p).count() for p in paths] == [1, 2, 3]
    assert not any(exists(spark, p) for p in paths)
    assert together([]) == []


def test_a_failing_call_fails_all():
    def fail():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        together([fail, lambda: 1])


def test_shares_of_the_learning_curve_are_fitted_at_once(spark):
    meet, own = threading.Barrier(2, timeout=120), ct.logreg_model()

    class Meeting(ct.Contender):
        def fit(self, *args, **kinds):
            meet.wait()
            return own.fit(*args, **kinds)

    rows = [(u, t, float(u + t), int(t > 5), "test" if u % 4 == 0 else "train") for u in range(16) for t in range(10)]
    frame = spark.createDataFrame(rows, "unit_id long, t_index int, a double, failure_within_h int, split string")
    curve = tr.learning_curve(Meeting("logreg", {}), frame, ["a"], shares=(0.5, 1.0)).collect()
    assert [r.share for r in curve] == [0.5, 1.0] and all(r.test_auc > 0.5 for r in curve)


def test_two_million_rows_are_fitted_by_model(spark):
    names = [f"f{k}" for k in range(9)]
    df = spark.range(2_000_000).select(*[F.lit(float(k)).alias(c) for k, c in enumerate(names)], (F.col("id") % 2).alias("y"))
    with scope():
        data = bo.table(df, names, "y")
        assert data.local.codes.shape == (9, 2_000_000)


def test_sums_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3, 50_000), dtype=np.uint8)
    g, h, at = np.rint(rng.normal(size=50_000) * 1e5), np.rint(rng.random(50_000) * 1e5), np.flatnonzero(rng.random(50_000) < 0.7)
    whole = bo.histograms(codes[:, at], g[at], h[at])[:, 0]
    monkeypatch.setattr(bo, "PIECE", 997)
    assert (bo.histograms_of(codes, g, h, at) == whole).all() and (bo.histograms(codes[:, at], g[at], h[at])[:, 0] == whole).all()

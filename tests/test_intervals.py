"""The cluster bootstrap against resampling done by hand with the same weights."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.operators import intervals as iv
from fleetwise.operators.grading import auc_of

SLICES = {"near": 0, "far": 1, "nowhere": 9}


def brute(scores, pos, neg):
    """AUC of weighted rows, ties half."""
    if not pos.sum() or not neg.sum():
        return None
    wins = (scores[:, None] > scores) + 0.5 * (scores[:, None] == scores)
    return float(pos @ wins @ neg / (pos.sum() * neg.sum()))


@pytest.fixture(scope="module")
def rows():
    """A third of the scores are equal, a third of the rows are one unit."""
    rng = np.random.default_rng(6)
    n = 900
    y = (rng.random(n) < 0.25).astype(int)
    score = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.random(n) + 0.2 * y, 2))
    unit = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"unit": unit, "score": score, "other": rng.random(n), "y": y, "band": rng.integers(0, 2, n)})


@pytest.fixture(params=["many", "one"])
def layout(spark, request):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false" if request.param == "many" else "true")
    yield request.param
    spark.conf.unset(setting)


def test_replicates_equal_resampling(spark, rows, layout):
    df = spark.createDataFrame(rows).repartition(5)
    slices = {name: F.col("band") == band for name, band in SLICES.items()}
    got = iv.auc_replicates(df, "score", "y", "unit", slices, replicates=12).toPandas().set_index(["slice", "replicate"])
    hashes = dict(df.select("unit", F.xxhash64("unit")).distinct().collect())
    units = np.array([hashes[u] for u in rows["unit"]])
    weights = iv.unit_weights(units, np.arange(13))
    s, y, band = (rows[c].to_numpy() for c in ("score", "y", "band"))
    for name, at in (("near", band == 0), ("far", band == 1)):
        for r in range(13):
            w = weights[:, r]
            want = brute(s, w * ((y == 1) & at), w * (y == 0))
            assert got.loc[(name, r), "roc_auc"] == pytest.approx(want, abs=1e-12)
            assert got.loc[(name, r), "n_positive"] == (w * ((y == 1) & at)).sum()
    assert got.loc["nowhere", "roc_auc"].isna().all()


def test_replicate_zero_is_the_auc(spark, rows):
    df = spark.createDataFrame(rows)
    got = iv.auc_intervals(df, "score", "y", "unit", replicates=30).first()
    assert got["roc_auc"] == pytest.approx(auc_of(df, "score", "y"))
    assert got["low"] < got["roc_auc"] < got["high"] and got["n_replicates"] == 30


def test_weights_are_poisson_and_differ_between_replicates():
    w = iv.unit_weights(np.arange(20_000) * 7919, np.arange(1, 6))
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.04)
    assert np.abs(np.corrcoef(w, rowvar=False) - np.eye(5)).max() < 0.03
    assert (iv.unit_weights(np.arange(9), np.array([0])) == 1).all()


def test_units_widen_the_interval(spark):
    """Rows of a unit repeat each other, so a thousand rows of twenty units are worth twenty."""
    rng = np.random.default_rng(1)
    y, s = np.arange(20) % 2, rng.random(20) + 0.4 * (np.arange(20) % 2)
    pdf = pd.DataFrame({"unit": np.repeat(np.arange(20), 50), "y": np.repeat(y, 50), "s": np.repeat(s, 50)})
    df = spark.createDataFrame(pdf.assign(row=range(1000)))
    width = lambda by: iv.auc_intervals(df, "s", "y", by).select(F.col("high") - F.col("low")).first()[0]
    assert width("unit") > 3 * width("row")


def test_difference_of_a_score_with_itself_is_nothing(spark, rows):
    df = spark.createDataFrame(rows)
    same = iv.auc_difference(df, "score", "score", "y", "unit", replicates=20).first()
    assert (same["difference"], same["low"], same["high"]) == (0.0, 0.0, 0.0)
    better = iv.auc_difference(df, "score", "other", "y", "unit", replicates=100).first()
    assert better["difference"] == pytest.approx(auc_of(df, "score", "y") - auc_of(df, "other", "y"))
    assert better["low"] > 0


def test_nulls_and_nothing(spark):
    kinds = "unit int, score double, y int"
    empty = spark.createDataFrame([], kinds)
    assert iv.auc_intervals(empty, "score", "y", "unit", replicates=5).count() == 0
    rows = [(None, None, 0), (None, 0.2, 1), (1, 0.1, None), (2, None, 1)]
    got = iv.auc_replicates(spark.createDataFrame(rows, kinds), "score", "y", "unit", replicates=0).first()
    assert (got["n_positive"], got["roc_auc"]) == (2, 0.75)

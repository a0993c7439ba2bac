"""Detectors that follow a curve or face many outliers, against what SQL-sized arithmetic says."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.detectors import joint as jt
from fleetwise.detectors import kernel as kn
from fleetwise.detectors import starts as st
from fleetwise.spec import DEFAULT

SPEC = DEFAULT.but(signals=("a", "b", "c"))


def frame(spark, x):
    pdf = pd.DataFrame(x, columns=["a", "b", "c"][: x.shape[1]])
    return spark.createDataFrame(pdf.assign(unit_id=0, t_index=range(len(x))))


def precision(scores, odd):
    order = np.argsort(-scores, kind="stable")
    hits = odd[order]
    return float((np.cumsum(hits) / np.arange(1, len(hits) + 1))[hits].mean())


@pytest.fixture(scope="module")
def clustered():
    """40 % of all rows in a tight cluster off the others."""
    rng = np.random.default_rng(3)
    good = rng.normal(size=(1800, 3)) @ np.array([[1.0, 0.6, 0.2], [0.0, 0.8, 0.3], [0.0, 0.0, 0.9]])
    bad = rng.normal(size=(1200, 3)) * 0.15 + np.array([6.0, -5.0, 4.0])
    return np.vstack([good, bad])


def test_clustered_contamination_is_found(spark, clustered):
    df = frame(spark, clustered)
    got = jt.RobustDistance(SPEC, support=0.55).fit(df).transform(df).toPandas().sort_values("t_index")
    d = got["distance"].to_numpy()
    assert d[1800:].min() > d[:1800].max()


def test_robust_shape_is_the_same_on_every_layout(spark, clustered):
    fit = lambda df: jt.RobustDistance(SPEC, support=0.6).fit(df).shape
    one, other = fit(frame(spark, clustered).coalesce(1)), fit(frame(spark, clustered[::-1]).repartition(13))
    np.testing.assert_allclose(one.centre, other.centre, atol=1e-9)
    np.testing.assert_allclose(one.inverse, other.inverse, rtol=1e-7)


def test_shape_is_that_of_the_rows_without_the_cluster(spark, clustered):
    df = frame(spark, clustered)
    model = jt.RobustDistance(SPEC, support=0.55).fit(df)
    scale = np.array([model.moments.scale[s] for s in SPEC.signals])
    centre = model.shape.centre * scale + np.array([model.moments.centre[s] for s in SPEC.signals])
    cov = np.linalg.inv(model.shape.inverse) * np.outer(scale, scale)
    np.testing.assert_allclose(centre, clustered[:1800].mean(0), atol=0.1)
    np.testing.assert_allclose(cov, np.cov(clustered[:1800], rowvar=False), atol=0.15)


def test_centre_and_scale_of_cells_match_numpy(spark):
    x = np.random.default_rng(5).normal(2.0, 3.0, size=(4001, 1))
    z = spark.createDataFrame(pd.DataFrame(x, columns=["a"])).repartition(5)
    counts = st.cell_counts(z, lambda v: v, st.spread_cells)[0]
    centre, scale = st.centre_and_scale(counts)
    s = np.sort(x[:, 0])
    shortest = (s[2000:] - s[:2001]).min() / 1.3489795
    assert counts.sum() == 4001
    assert centre == pytest.approx(np.median(x), abs=0.05)
    assert scale == pytest.approx(shortest, abs=0.05)


@pytest.mark.parametrize("rows", [1, 2, 40])
def test_equal_rows_have_a_shape(spark, rows):
    df = frame(spark, np.ones((rows, 3)))
    got = jt.RobustDistance(SPEC).fit(df).transform(df).toPandas()["distance"]
    assert np.isfinite(got).all() and got.nunique() == 1


def test_empty_tables_are_refused(spark):
    df = spark.createDataFrame([], "unit_id int, t_index int, a double, b double, c double")
    with pytest.raises(ValueError, match="no rows"):
        jt.RobustDistance(SPEC).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        kn.KernelReconstructionDetector(SPEC).fit(df)


def bent_sheet(height):
    """Rows on a bent sheet, and a few off it that stay inside its range."""
    rng = np.random.default_rng(8)
    t = rng.uniform(-np.pi, np.pi, 3000)
    h = rng.uniform(-1.5, 1.5, 3000) if height == "even" else rng.normal(size=3000)
    x = np.column_stack([np.cos(t), np.sin(t), 0.3 * h]) + rng.normal(size=(3000, 3)) * 0.03
    odd = np.zeros(3000, dtype=bool)
    odd[:60] = True
    x[odd, :2] *= rng.uniform(0.0, 0.5, size=(60, 1))
    return x, odd


@pytest.mark.parametrize("height, floor", [("even", 0.6), ("normal", 0.1)])
def test_a_curve_is_followed(spark, height, floor):
    """A normal height has rare rows of its own at both ends of the sheet, so precision is lower there."""
    x, odd = bent_sheet(height)
    df = frame(spark, x)
    bent = kn.KernelReconstructionDetector(SPEC).fit(df).transform(df).toPandas().sort_values("t_index")
    flat = jt.ReconstructionDetector(SPEC, directions=2).fit(df).transform(df).toPandas().sort_values("t_index")
    found = precision(bent["kernel_reconstruction"].to_numpy(), odd)
    assert found > floor and found > 5 * precision(flat["reconstruction"].to_numpy(), odd)


def test_kernel_errors_match_numpy(spark):
    x = bent_sheet("even")[0][:700]
    df = frame(spark, x).repartition(6)
    model = kn.KernelReconstructionDetector(SPEC, features=32, ridge=1e-3).fit(df)
    got = model.errors(df, "e").toPandas().sort_values("t_index")["e"]
    phi = model.fourier.of((x - x.mean(0)) / x.std(0, ddof=1))
    off = phi - phi.mean(0)
    solved = np.linalg.solve(np.cov(off, rowvar=False, bias=True) + 1e-3 * np.eye(32), off.T).T
    np.testing.assert_allclose(got, 1e-3 * (off * solved).sum(1), atol=1e-9)


def test_missing_signals_and_clashing_names(spark):
    x, _ = bent_sheet("even")
    df = frame(spark, x[:300]).withColumn("a", F.when(F.col("t_index") % 3 > 0, F.col("a")))
    df = df.withColumn("c", F.lit(None).cast("double")).withColumn("_z_a", F.lit("x"))
    got = kn.KernelReconstructionDetector(SPEC).fit(df).transform(df)
    assert got.columns == [*df.columns, "kernel_reconstruction"]
    assert got.filter("kernel_reconstruction BETWEEN 0 AND 1").count() == 300

"""Blocked windows against pandas recurrences; causality; order of the input."""

from pyspark.sql import Window
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.operators import windows as wn
from fleetwise.operators.aggregates import shape_rates
from fleetwise.operators.blocks import in_blocks
from fleetwise.spec import DEFAULT

SIGNALS = ("a", "b")
SPEC = DEFAULT.but(signals=SIGNALS, window_rows=6, rollup_rows=3, block_rows=16)


def frame(seed=0, hot=400):
    """One unit of ``hot`` rows, a few short ones; runs, creeps and gaps in the values."""
    rng = np.random.default_rng(seed)
    parts = []
    for unit, n in enumerate([hot, 37, 16, 17, 5, 1]):
        a = rng.integers(0, 4, n) / 2.0
        b = np.where(np.arange(n) % 40 < 20, np.arange(n) * 1.5, rng.normal(size=n))
        stuck = np.arange(n) % 50 >= 30
        a = np.where(stuck, 7.0, a)
        a[rng.random(n) < 0.1] = np.nan
        b[rng.random(n) < 0.02] = np.nan
        parts.append(
            pd.DataFrame({"unit_id": unit, "t_index": np.arange(n), "timestamp_h": np.arange(n) * 2.0, "a": a, "b": b})
        )
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf, signals=SIGNALS):
    df = spark.createDataFrame(pdf.sample(frac=1.0, random_state=1))
    return df.withColumns({s: F.when(~F.isnan(s), F.col(s)) for s in signals})


def back(df, columns):
    pdf = df.toPandas().sort_values(["unit_id", "t_index"]).reset_index(drop=True)
    return pdf[columns].astype("float64")


def test_temporal_features_match_rolling(spark):
    pdf = frame()
    got = wn.temporal_features(to_spark(spark, pdf), SPEC)
    for s in SIGNALS:
        g = pdf.groupby("unit_id")[s]
        roll = g.rolling(6, min_periods=2)
        step = g.diff().groupby(pdf["unit_id"]).rolling(6, min_periods=1)
        want = pd.DataFrame(
            {
                f"{s}__mean": roll.mean().to_numpy(),
                f"{s}__std": roll.std().to_numpy(),
                f"{s}__slope": step.mean().to_numpy(),
                f"{s}__delta": (pdf[s] - g.shift(5)).to_numpy(),
            }
        )
        np.testing.assert_allclose(back(got, list(want.columns)), want, atol=1e-6, equal_nan=True)


def test_block_size_does_not_matter(spark):
    df = to_spark(spark, frame(2))
    columns = wn.temporal_columns(SPEC)[2:]
    small = back(wn.temporal_features(df, SPEC), columns)
    large = back(wn.temporal_features(df, SPEC.but(block_rows=4096)), columns)
    pd.testing.assert_frame_equal(small, large, check_exact=True)


def test_rows_without_numbers_are_numbered_first(spark):
    pdf = frame(3)
    gaps = pdf.assign(t_index=pdf["t_index"] * 30 + 7)
    columns = wn.temporal_columns(SPEC)[2:]
    numbered = back(wn.temporal_features(to_spark(spark, gaps), SPEC.but(position=None)), columns)
    plain = back(wn.temporal_features(to_spark(spark, pdf), SPEC), columns)
    pd.testing.assert_frame_equal(numbered, plain, check_exact=True)


@pytest.mark.parametrize("missing", [3, 16, 40])
def test_a_gap_in_the_positions_fails_loudly(spark, missing):
    df = to_spark(spark, frame(3)).filter(~((F.col("unit_id") == 0) & (F.col("t_index") == missing)))
    for op in (wn.temporal_features, wn.equal_run):
        with pytest.raises(Exception, match="does not count"):
            op(df, SPEC).write.format("noop").mode("overwrite").save()
    assert wn.temporal_features(df, SPEC.but(position=None)).count() == df.count()


def runs(values):
    out, length = [], 0
    for i, v in enumerate(values):
        same = i > 0 and not np.isnan(v) and v == values[i - 1]
        length = length + 1 if same else 0
        out.append(length)
    return out


def test_equal_run_crosses_blocks(spark):
    pdf = frame(4)
    pdf.loc[(pdf["unit_id"] == 0) & pdf["t_index"].between(10, 200), "a"] = 3.25
    got = back(wn.equal_run(to_spark(spark, pdf), SPEC), ["a__run", "b__run"])
    for s in SIGNALS:
        want = np.concatenate([runs(g[s].to_numpy()) for _, g in pdf.groupby("unit_id")])
        assert got[f"{s}__run"].tolist() == want.tolist()


def test_stuck_and_monotone_match_recurrences(spark):
    pdf = frame(5)
    spec = SPEC.but(block_rows=32)
    got = back(
        wn.shape_flags(to_spark(spark, pdf), SIGNALS, SIGNALS, spec),
        [f"{s}__{k}" for s in SIGNALS for k in ("stuck", "monotone")],
    )
    for s in SIGNALS:
        stuck, mono = [], []
        for _, g in pdf.groupby("unit_id"):
            v = g[s].to_numpy()
            run = runs(v)
            flag = np.zeros(len(v))
            for i, r in enumerate(run):
                if r >= 4:
                    flag[i - 4 : i + 1] = 1
            stuck += flag.tolist()
            sign = pd.Series(np.sign(np.diff(v, prepend=np.nan)))
            mean = sign.rolling(12, min_periods=12).mean()
            mono += (mean.abs() >= 0.9).astype(float).tolist()
        assert stuck == got[f"{s}__stuck"].tolist()
        assert mono == got[f"{s}__monotone"].tolist()
        assert sum(stuck) + sum(mono) > 0


def test_shape_rates(spark):
    pdf = frame(6)
    got = shape_rates(to_spark(spark, pdf), SPEC).toPandas().set_index("signal")
    same = pdf.groupby("unit_id")["a"].transform(lambda v: v.eq(v.shift()))
    assert got.loc["a", "repeat_rate"] == pytest.approx(same[pdf["a"].notna()].mean())
    assert not got.loc["a", "continuous"]


def test_future_rows_do_not_change_the_past(spark):
    pdf = frame(7)
    bumped = pdf.copy()
    bumped.loc[(pdf["unit_id"] == 1) & (pdf["t_index"] == 36), "a"] += 9999
    columns = wn.temporal_columns(SPEC)
    before = back(wn.temporal_features(to_spark(spark, pdf), SPEC), columns)
    after = back(wn.temporal_features(to_spark(spark, bumped), SPEC), columns)
    past = ~((pdf["unit_id"] == 1) & (pdf["t_index"] == 36))
    pd.testing.assert_frame_equal(before[past], after[past], check_exact=True)


def test_window_tensor_pads_left_and_marks_gaps(spark):
    pdf = pd.DataFrame(
        {"unit_id": 1, "t_index": range(3), "timestamp_h": 0.0, "a": [1.0, np.nan, 3.0], "b": [2.0, 2.0, 2.0]}
    )
    got = wn.window_tensor(
        to_spark(spark, pdf), {"a": 1.0, "b": 0.0}, {"a": 2.0, "b": 1.0}, SPEC
    ).toPandas().sort_values("t_index")
    assert list(got["a__values"].iloc[2]) == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert list(got["a__present"].iloc[2]) == [0.0, 0.0, 0.0, 1.0, 0.0, 1.0]
    assert list(got["b__values"].iloc[0]) == [0.0, 0.0, 0.0, 0.0, 0.0, 2.0]


def test_a_long_unit_is_spread_over_blocks(spark):
    blocks = in_blocks(to_spark(spark, frame(0, hot=3000)), SPEC, behind=6)
    largest = blocks.groupBy("unit_id", "_block").count().agg(F.max("count")).first()[0]
    assert largest <= SPEC.block_rows + 6


def test_one_shuffle_and_one_sort_for_all_temporal_features(readings):
    plan = wn.temporal_features(readings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "failure_mode" not in plan and "is_outlier" not in plan


def test_time_to_failure(spark):
    pdf = pd.DataFrame(
        {
            "unit_id": [1] * 4 + [2] * 2,
            "t_index": [0, 1, 2, 3, 0, 1],
            "timestamp_h": [0.0, 2.0, 4.0, 6.0, 0.0, 3.0],
            "failure_within_h": [0, 1, 1, 0, 0, 0],
        }
    )
    got = wn.time_to_failure(spark.createDataFrame(pdf)).toPandas()
    got = got.sort_values(["unit_id", "t_index"])["time_to_failure_h"].tolist()
    inf = float("inf")
    assert got == [inf, 4.0, 2.0, inf, inf, inf]


def test_frames_are_made_by_block_and_gaps_are_found(spark):
    rows = [(u, t, None if t % 7 == 3 else (float("nan") if t == 20 else (u or 0) * 10.0 + t % 5)) for u in (None, 1, 2) for t in range(60)]
    spec = SPEC.but(unit="u", time="t", clock="t", position="t", signals=("a",), window_rows=6, block_rows=16)
    df = spark.createDataFrame(rows, "u int, t int, a double")
    for made in (wn.temporal_features(df, spec), wn.window_tensor(df, {"a": 1.0}, {"a": 2.0}, spec)):
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("u").orderBy("t").rowsBetween(-5, 0)
    want = df.select("u", "t", F.when(F.count("a").over(w) >= 2, F.avg("a").over(w)).alias("m"), F.stddev_samp("a").over(w).alias("s"))
    got = wn.temporal_features(df, spec).select("u", "t", "a__mean", "a__std")
    order = lambda f: sorted(map(tuple, f.collect()), key=lambda r: (r[0] or 0, r[1]))
    for g, e in zip(order(got), order(want), strict=True):
        assert g[:2] == e[:2]
        assert g[2:] == pytest.approx(e[2:], nan_ok=True) if None not in e[2:] else g == e
    with pytest.raises(Exception, match="does not count"):
        wn.window_tensor(df.filter("t <> 30"), {"a": 1.0}, {"a": 2.0}, spec).collect()

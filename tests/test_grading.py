import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.operators import grading as gr
from fleetwise.operators import rollup as ru
from fleetwise.operators.aggregates import (
    DataQualitySpike,
    data_quality_check,
    fit_minmax,
    minmax01,
)
from fleetwise.spec import DEFAULT


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(1)
    y = (rng.random(1500) < 0.2).astype(int)
    s = np.round(rng.random(1500) * 0.7 + 0.3 * y * rng.random(1500), 2)
    return pd.DataFrame({"y": y, "s": s, "g": rng.integers(0, 3, 1500)})


def test_auc_is_exact_with_ties(spark, labelled):
    got = gr.auc_of(spark.createDataFrame(labelled), "s", "y")
    assert got == pytest.approx(brute_auc(labelled["y"].to_numpy(), labelled["s"].to_numpy()))


def test_auc_per_group(spark, labelled):
    got = gr.roc_auc(spark.createDataFrame(labelled), "s", "y", ["g"]).toPandas().set_index("g")
    for g, part in labelled.groupby("g"):
        want = brute_auc(part["y"].to_numpy(), part["s"].to_numpy())
        assert got.loc[g, "roc_auc"] == pytest.approx(want)


def test_auc_of_one_class_is_null_or_raises(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    assert gr.auc_of(df, "s", "y") is None
    with pytest.raises(gr.DegenerateSplit):
        gr.auc_of(df, "s", "y", strict=True)


def test_sparse_scores_alarm_exactly_their_ones(spark):
    scores = [(i, 1.0 if i < 10 else 0.0) for i in range(1000)]
    df = spark.createDataFrame(scores, "i int, s double")
    assert gr.alarm_set(df, "s", 0.02).count() == 10


def test_dense_scores_fill_the_budget(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"s": rng.random(1000)}))
    assert abs(gr.alarm_set(df, "s", 0.05).count() - 50) <= 1


def test_a_tie_above_the_budget_alarms_nothing(spark):
    df = spark.createDataFrame([(1.0,)] * 100, "s double")
    assert gr.alarm_set(df, "s", 0.02).count() == 0


def test_ladder_grades_match_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 1200
    pdf = pd.DataFrame(
        {
            "detector": rng.choice(["x", "z"], n),
            "score": np.round(rng.random(n), 2),
            "anomaly_type": rng.choice(["", "", "", "sensor_stuck", "obvious_outlier"], n),
        }
    )
    pdf["is_outlier"] = pdf["anomaly_type"] != ""
    got = gr.ladder_grades(spark.createDataFrame(pdf)).toPandas().set_index("detector")
    for name, part in pdf.groupby("detector"):
        s, y = part["score"].to_numpy(), part["is_outlier"].to_numpy().astype(int)
        assert got.loc[name, "roc_auc"] == pytest.approx(brute_auc(y, s))
        k = max(1, round(0.02 * len(s)))
        alarm = np.array([(s >= v).sum() <= k for v in s])
        stuck = (part["anomaly_type"] == "sensor_stuck").to_numpy()
        assert got.loc[name, "recall_sensor_stuck"] == pytest.approx(alarm[stuck].mean())
        order = np.unique(s)[::-1]
        hits = [((s >= t) & (y == 1)).sum() for t in order]
        precision = [h / (s >= t).sum() for h, t in zip(hits, order)]
        want = np.sum(np.diff([0, *hits]) / y.sum() * np.array(precision))
        assert got.loc[name, "average_precision"] == pytest.approx(want)
        assert pd.isna(got.loc[name, "recall_joint_outlier"])


def test_batch_summary(spark):
    df = spark.createDataFrame([(p,) for p in (0.1, 0.2, 0.9, 0.95, 0.5, 1.0)][:5], "p double")
    got = gr.batch_summary(df, "p").toPandas()
    assert got["n_high_risk"].iloc[0] == 3 and got["pct_high_risk"].iloc[0] == 60.0
    assert len(got) == 10 and got["n"].sum() == 5
    top = gr.batch_summary(spark.createDataFrame([(1.0,)], "p double"), "p").toPandas()
    assert top.set_index("bin").loc[9, "n"] == 1


def test_audit_trips(spark):
    rows = [(0.95, 0.75, 0.8), (0.80, 0.78, 0.505), (0.8, 0.75, 0.7)]
    df = spark.createDataFrame(rows, "train_auc double, cv_auc double, test_auc double")
    assert [r["tripped"] for r in gr.audit_fit(df).collect()] == [True, True, False]
    with pytest.raises(gr.FitAudit):
        gr.audit_fit(df, strict=True)


def test_minmax_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert {r["u"] for r in minmax01(df, "x", "u").collect()} == {0.0}
    spread = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert sorted(r["u"] for r in minmax01(spread, "x", "u").collect()) == [0.0, 0.0, 1.0]
    later = spark.createDataFrame([(9.0,)], "x double")
    assert later.select(fit_minmax(spread, ["x"])["x"].of(F.col("x"))).first()[0] == 1.0


def test_quality_check_trips_on_poison_only(spark):
    clean = spark.createDataFrame([(0.6 if i % 50 == 0 else 0.1,) for i in range(500)], "s double")
    poisoned = spark.createDataFrame([(0.9,)] * 20, "s double")
    assert not data_quality_check(clean, "s", 0.02).first()["tripped"]
    assert data_quality_check(poisoned, "s", 0.02).first()["tripped"]
    with pytest.raises(DataQualitySpike):
        data_quality_check(poisoned, "s", 0.02, strict=True)


def unit_scores(spark, series):
    rows = [(u, t, float(p)) for u, ps in series.items() for t, p in enumerate(ps)]
    return spark.createDataFrame(rows, "unit_id string, t_index int, p double")


def test_a_spike_is_not_sustained_risk(spark):
    spiky = [0.05] * 60
    spiky[30] = 1.0
    df = unit_scores(spark, {"spiky": spiky, "degrading": [0.05] * 40 + [0.8] * 20})
    got = ru.unit_rollup(df, "p").toPandas().set_index("unit_id")
    assert got.loc["spiky", "peak"] == 1.0 and not got.loc["spiky", "flagged"]
    assert got.loc["degrading", "risk"] == pytest.approx(0.8) and got.loc["degrading", "flagged"]


def test_rollup_shares(spark):
    df = unit_scores(spark, {"b": [0.1] * 24, "a": [0.9] * 24})
    got = ru.unit_rollup(df, "p").orderBy(F.desc("risk")).toPandas()
    assert got["unit_id"].tolist() == ["a", "b"]
    assert got["high_risk_share"].tolist() == [1.0, 0.0]
    assert ru.fleet_report(spark.createDataFrame(got)).first().asDict() == {
        "n_units": 2,
        "n_flagged": 1,
        "n_rows_scored": 48,
    }


def test_misaligned_scores_are_refused(spark):
    df = unit_scores(spark, {"a": [0.1] * 5})
    short = df.filter("t_index < 4").withColumnRenamed("p", "q")
    with pytest.raises(ru.Misaligned):
        ru.join_scores(df, short)
    twice = df.union(df).withColumnRenamed("p", "q")
    with pytest.raises(ru.Misaligned):
        ru.join_scores(df, twice)


def test_rule_p95_matches_pandas(spark):
    rng = np.random.default_rng(2)
    series = {f"u{i}": rng.random(100 + i) for i in range(4)}
    df = unit_scores(spark, series).withColumn("failure_within_h", F.lit(0))
    got = ru.rule_values(df, "p").toPandas().set_index("unit_id")
    for u, p in series.items():
        assert got.loc[u, "p95"] == pytest.approx(np.quantile(p, 0.95))
        assert got.loc[u, "mean_72"] == pytest.approx(
            pd.Series(p).rolling(72, min_periods=1).mean().max()
        )


def test_bands_cover_all_times():
    assert list(gr.horizon_bands()) == [
        "[0,6) h", "[6,24) h", "[24,72) h", "[72,168) h", "[168,inf) h",
    ]
    assert DEFAULT.rollup_rows == 12

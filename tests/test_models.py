"""Detectors, drift, classifiers and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.detectors import joint as jt
from fleetwise.detectors.ladder import SUSPECT, DetectorLadder, SuspectFeature, score_ladder
from fleetwise.learn import contenders as ct
from fleetwise.learn import training as tr
from fleetwise.operators import drift as dr
from fleetwise.operators import projection as pj
from fleetwise.operators import rollup as ru
from fleetwise.operators.aggregates import data_quality_check, impute, signal_medians, suspect_rate
from fleetwise.operators.grading import DegenerateSplit, auc_of
from fleetwise.plans import ceiling as cl
from fleetwise.plans import retrain as rt
from fleetwise.queries.base import SCORE
from fleetwise.queries.tables import SHIFTS
from fleetwise.sources.predictions import LOG_SCHEMA
from fleetwise.spec import DEFAULT, SIGNALS
from fleetwise.streaming import jobs as st

QUICK = {"n_estimators": 5, "num_leaves": 8, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def ladder(readings):
    return DetectorLadder(trees=30).fit(readings)


# -- detectors -----------------------------------------------------------------------------------


def test_scores_lie_between_0_and_1_and_do_not_read_labels(readings, ladder):
    bare = readings.select(*DEFAULT.key, *SIGNALS)
    got = ladder.transform(bare)
    assert got.count() == readings.count()
    for name in ladder.names:
        low, high = got.agg(F.min(name), F.max(name)).first()
        assert 0.0 <= low <= high <= 1.0
        assert got.filter(F.col(name).isNull()).count() == 0


def test_signals_come_back_unfilled(readings, ladder):
    got = ladder.transform(readings.select(*DEFAULT.key, *SIGNALS))
    assert got.filter("egt_c IS NULL").count() == readings.filter("egt_c IS NULL").count()


def test_forest_is_repeatable(readings):
    rows = readings.filter("unit_id < 10").select(*DEFAULT.key, *SIGNALS)
    filled = impute(rows, signal_medians(rows))
    fit = lambda df: jt.IsolationForest(trees=10).fit(df).forest
    a, b = fit(filled), fit(filled.repartition(7))
    np.testing.assert_array_equal(a.cut, b.cut)
    assert len(a.feature) == 10


def test_forest_samples_are_bounded(spark):
    for n in (50, 3000):
        df = spark.range(n).select(
            F.col("id").alias("unit_id"), F.lit(0).alias("t_index"), F.rand(1).alias("a")
        )
        spec = DEFAULT.but(signals=("a",))
        sizes = jt.tree_samples(df, spec, 20, 64, 42).groupBy("tree").count().toPandas()["count"]
        assert len(sizes) == 20 and sizes.max() <= max(n, 64) and sizes.min() >= min(n, 64) * 0.8


def test_distance_finds_a_broken_correlation(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=2000)
    pdf = pd.DataFrame({"unit_id": 0, "t_index": range(2000), "a": a, "b": 2 * a + rng.normal(size=2000) * 0.05})
    pdf.loc[:19, "b"] = -2 * pdf.loc[:19, "a"] + 1
    spec = DEFAULT.but(signals=("a", "b"))
    df = spark.createDataFrame(pdf)
    got = jt.RobustDistance(spec).fit(df).transform(df).toPandas().sort_values("distance")
    assert set(got["t_index"].tail(15)) <= set(range(20))


def test_reconstruction_error_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(unit_id=0, t_index=range(500))
    spec = DEFAULT.but(signals=("a", "b", "c"))
    df = spark.createDataFrame(pdf)
    model = jt.ReconstructionDetector(spec, directions=1).fit(df)
    got = df.select("t_index", model.error().alias("e")).toPandas().sort_values("t_index")["e"]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    v = np.linalg.svd(z, full_matrices=False)[2][:1]
    want = ((z - z @ v.T @ v) ** 2).mean(1)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_ladder_catches_stuck_sensors(readings, ladder):
    grades = score_ladder(readings, model=ladder).toPandas().set_index("detector")
    assert grades.loc["temporal", "recall_sensor_stuck"] > 0.9
    assert (grades["roc_auc"] > 0.6).all()


def test_watcher_trips_on_outliers_only(readings):
    clean = readings.filter("NOT is_outlier AND failure_within_h = 0")
    loose = DEFAULT.but(position=None)  # rows are missing in between
    model = SuspectFeature(loose, trees=30).fit(clean)
    half_a, half_b = clean.filter("unit_id % 2 = 1"), clean.filter("unit_id % 2 = 0")
    baseline = max(suspect_rate(model.transform(half_a), SUSPECT, 0.35).first()["suspect_rate"], 0.005)
    assert not data_quality_check(model.transform(half_b), SUSPECT, baseline, flag=0.35).first()["tripped"]
    # whole units keep their series intact; only outlier rows are judged
    scored = model.transform(readings).filter("anomaly_type = 'obvious_outlier'")
    assert data_quality_check(scored, SUSPECT, baseline, flag=0.35).first()["tripped"]


# -- drift ---------------------------------------------------------------------------------------


def test_drift_fires_on_a_shift_and_not_on_a_copy(readings):
    moved = dr.feature_drift(readings, pj.scenario_shift(readings, SHIFTS))
    assert {r["signal"] for r in moved.filter("drifted").collect()} == set(SHIFTS)
    assert dr.drift_decision(moved).first()["drifted"]
    copy = dr.drift_decision(dr.feature_drift(readings, readings)).first()
    assert (copy["drifted"], copy["n_drifted"]) == (False, 0)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(2)
    spec = DEFAULT.but(signals=("a",))
    a, b = np.round(rng.normal(size=700), 2), np.round(rng.normal(0.3, 1.2, size=500), 2)
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"a": v}))
    got = dr.distances(frame(a), frame(b), spec).first()
    grid = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    g = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert got["ks"] == pytest.approx(np.abs(f - g).max())
    assert got["wasserstein"] == pytest.approx((np.abs(f - g)[:-1] * np.diff(grid)).sum())
    assert got["ref_std"] == pytest.approx(a.std())
    assert got["ks_p_value"] < 1e-4
    small = dr.feature_drift(frame(a), frame(b), spec, test="ks").first()
    assert small["test"] == "ks" and small["drifted"]


def test_a_signal_absent_from_one_batch_does_not_drift(spark):
    spec = DEFAULT.but(signals=("a", "b"))
    df = spark.createDataFrame([(float(i), None) for i in range(50)], "a double, b double")
    other = spark.createDataFrame([(float(i), 1.0) for i in range(50)], "a double, b double")
    got = dr.feature_drift(df, other, spec).toPandas().set_index("signal")
    assert not got["drifted"].any() and pd.isna(got.loc["b", "ks"]) and got.loc["a", "ks"] == 0


# -- classifiers ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(readings):
    return tr.prepare(readings)[0]


def test_unknown_parameters_are_refused():
    with pytest.raises(ValueError):
        ct.logreg_model(overrides={"gamma": 1})
    with pytest.raises(ValueError):
        ct.boosted_model(overrides={"C": 1})
    assert [c.name for c in ct.model_field()] == ["logreg", "boosted"]
    assert ct.boosted_model().params["n_estimators"] == 200


@pytest.mark.parametrize("contender", [ct.logreg_model(), ct.boosted_model(overrides=QUICK)], ids=["logreg", "boosted"])
def test_contenders_learn(frame, contender):
    fitted = contender.fit(tr.side(frame, "train"), SIGNALS)
    scored = fitted.score(tr.side(frame, "test"))
    assert auc_of(scored, "probability", DEFAULT.target) > 0.7
    names = [n for n, _ in fitted.importance()]
    assert sorted(names) == sorted(SIGNALS)


def test_labels_cannot_be_features(frame):
    with pytest.raises(pj.Leakage):
        ct.logreg_model().fit(frame, [*SIGNALS, DEFAULT.target])


def test_one_class_cannot_be_fitted(frame):
    with pytest.raises(DegenerateSplit):
        ct.logreg_model().fit(frame.filter("failure_within_h = 0"), SIGNALS)


def test_a_signal_that_is_always_missing_is_left_out(frame):
    gone = frame.withColumn("egt_c", F.lit(None).cast("double"))
    for contender in (ct.logreg_model(), ct.boosted_model(overrides=QUICK)):
        fitted = contender.fit(gone, SIGNALS)
        assert "egt_c" not in fitted.present
        assert fitted.score(gone).filter("probability IS NULL").count() == 0


def test_oof_rows_are_scored_once(frame):
    train = tr.side(frame, "train")
    oof = tr.oof_predictions(ct.boosted_model(overrides=QUICK), train, SIGNALS, folds=3)
    assert oof.count() == train.count() == oof.select(*DEFAULT.key).distinct().count()
    assert oof.groupBy("unit_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_search_is_seeded():
    import random

    draw = lambda: tr.suggest("boosted", random.Random("42:boosted"))
    assert draw() == draw()
    assert set(draw()) == set(ct.BOOSTED_TUNABLE)


def test_learning_curve_grows(frame):
    got = tr.learning_curve(ct.boosted_model(overrides=QUICK), frame, SIGNALS, shares=(0.5, 1.0)).toPandas()
    assert got["share"].tolist() == [0.5, 1.0] and (got["test_auc"] > 0.6).all()


def test_ceiling_has_the_expected_shape(readings):
    report = cl.ceiling_report(readings, contender=ct.boosted_model(overrides=QUICK), folds=2)
    horizon = report.by_horizon.toPandas().set_index("slice")["roc_auc"]
    assert horizon["[0,6) h"] > horizon["[72,168) h"]
    bound = report.bound.first()
    assert bound["diagnostic"] and bound["leaky_auc"] > 0.99 and bound["gap"] > 0
    rungs = report.stacking.toPandas().set_index("rung")["roc_auc"]
    assert rungs["boosted_temporal"] > rungs["boosted_perrow"] > 0.5


def test_retrain_only_on_drift(spark, readings):
    live = spark.createDataFrame([], "name string, live_version long, live_auc double")
    still = rt.drift_retrain_job(readings, readings, live)
    assert still.comparison is None and still.promotion is None
    moved = rt.drift_retrain_job(
        readings, pj.scenario_shift(readings, SHIFTS), live, tuned={"boosted": QUICK}, clean=False
    )
    row = moved.promotion.first()
    assert (row["promoted"], row["reason"], row["version"]) == (True, "first", 1)


# -- streams -------------------------------------------------------------------------------------


def slices(spark, df, path, cuts):
    """Append the rows in time order, one file per slice."""
    edges = [-1, *cuts, 10**9]
    for low, high in zip(edges, edges[1:]):
        part = df.filter((F.col("t_index") > low) & (F.col("t_index") <= high))
        part.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def few(readings):
    return readings.filter("unit_id <= 6").withColumn("score", F.expr(SCORE))


def test_sustained_risk_in_batches_equals_the_table(spark, few, tmp_path):
    spec = DEFAULT.but(block_rows=64)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = few.select(*DEFAULT.key, "score")
    slices(spark, rows, source, [50, 200, 201, 400])
    stream = st.reading_stream(spark, source, rows.schema, files_per_batch=1)
    st.sustained_risk_stream(stream, "score", out, str(tmp_path / "cp"), spec).awaitTermination()
    got = st.unit_risk(spark.read.parquet(out)).toPandas().sort_values("unit_id")
    want = ru.unit_rollup(rows, "score").toPandas().sort_values("unit_id")
    for c in ("n_rows", "peak", "high_risk_share", "flagged"):
        assert got[c].tolist() == want[c].tolist()
    np.testing.assert_allclose(got["risk"], want["risk"], atol=1e-12)


def test_late_rows_are_ignored(spark, few, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = few.select(*DEFAULT.key, "score")
    slices(spark, rows, source, [100])
    rows.filter("t_index < 20").withColumn("score", F.lit(1.0)).coalesce(1).write.mode("append").parquet(source)
    stream = st.reading_stream(spark, source, rows.schema, files_per_batch=1)
    st.sustained_risk_stream(stream, "score", out, str(tmp_path / "cp")).awaitTermination()
    got = st.unit_risk(spark.read.parquet(out)).toPandas()
    assert got["n_rows"].sum() == rows.count()


def test_score_stream_logs_every_row_once_over_a_restart(spark, few, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "cp"))
    rows = few.select(*DEFAULT.key, "timestamp_h", *SIGNALS)
    run = lambda: st.score_stream(
        st.reading_stream(spark, source, rows.schema),
        lambda df: df.withColumn("score", F.expr(SCORE)),
        "score",
        "9",
        log,
        state,
    ).awaitTermination()
    slices(spark, rows.filter("t_index < 100"), source, [50])
    run()
    slices(spark, rows.filter("t_index >= 100"), source, [300])
    run()
    got = spark.read.schema(LOG_SCHEMA).parquet(log)
    assert got.count() == rows.count()


def test_a_fitted_model_scores_a_stream(spark, readings, few, tmp_path):
    model = jt.ReconstructionDetector().fit(readings)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    slices(spark, few.select(*DEFAULT.key, "timestamp_h", *SIGNALS), source, [])
    stream = st.reading_stream(spark, source, spark.read.parquet(source).schema)
    st.quality_stream(
        stream, model.scale.of(model.error()), 0.01, out, str(tmp_path / "cp"), every="24 hours"
    ).awaitTermination()
    got = spark.read.parquet(out).toPandas()
    last = few.agg(F.max("timestamp_h")).first()[0]
    assert len(got) == int((last - 1) // 24)
    assert got["n_rows"].sum() == few.filter(f"timestamp_h < {24 * len(got)}").count()


def test_full_trees_give_the_path_lengths_of_the_nodes(spark, readings):
    forest = jt.IsolationForest(trees=5).fit(readings.select("unit_id", "t_index", *jt.DEFAULT.signals).fillna(0.0)).forest
    x = np.random.default_rng(4).normal(300, 300, size=(5000, 9))
    x[::9, 2], x[::7, 5] = np.nan, np.inf
    total = np.zeros(len(x))
    for feature, cut, left, length in zip(forest.feature, forest.cut, forest.left, forest.length):
        for i, row in enumerate(x):
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(row[feature[node]] > cut[node])
            total[i] += length[node]
    feature, cut, last = forest.full()
    assert feature.shape == cut.shape == (5, 255) and last.shape == (5, 256)
    want = np.exp2(-total / (5 * jt.path_correction(forest.rows)))
    assert (forest.scores(x) == want).all()


def test_a_query_ranks_with_the_label_beside_the_score(spark):
    from fleetwise.queries.learning import _ranking

    rows = [(1, t, t / 10.0, int(t > 5)) for t in range(10)] + [(None, 1, 0.1, 0)]
    df = spark.createDataFrame(rows, "unit_id long, t_index int, s double, y int")
    assert [tuple(r)[2:] for r in _ranking(df, "y", {"s": 0.9}).collect()] == [(True, True)] * 11
    assert {r.ranks for r in _ranking(df, "y", {"s": 1.1}).collect()} == {False}

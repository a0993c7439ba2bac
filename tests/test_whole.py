"""Nothing is lost, doubled or left behind."""

import os

import numpy as np
import pytest
from dataclasses import replace
from pyspark.sql import functions as F

from fleetwise.detectors import joint as jt
from fleetwise.learn.contenders import Profile, repeated
from fleetwise.operators import drift as dr
from fleetwise.operators import grading as gr
from fleetwise.operators.ordered import rank_within, running_totals
from fleetwise.operators.rollup import sustained_risk
from fleetwise.shared import kept, scope, shared_folder, stored
from fleetwise.sources.runs import page_of
from fleetwise.spec import DEFAULT, SIGNALS
from fleetwise.streaming import jobs as st


def test_late_rows_of_a_closed_block_count_once(spark, tmp_path):
    spec = replace(DEFAULT, block_rows=64)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "unit_id bigint, t_index int, score double"
    spark.createDataFrame([(1, t, 0.1) for t in range(130)], kind).coalesce(1).write.parquet(source)
    late = [(1, t, 1.0) for t in [*range(20), 63, 64, 65]]
    spark.createDataFrame(late, kind).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = st.reading_stream(spark, source, schema, files_per_batch=1)
    st.sustained_risk_stream(stream, "score", out, str(tmp_path / "cp"), spec).awaitTermination()
    got = st.unit_risk(spark.read.parquet(out)).first()
    assert (got["n_rows"], round(got["risk"], 9), got["flagged"]) == (130, 0.1, False)


def test_a_null_position_is_refused(spark):
    rows = [(1, 0, 0.1), (1, 1, 0.1), (1, None, 0.9), (1, 2, 0.1)]
    df = spark.createDataFrame(rows, "unit_id bigint, t_index int, score double")
    with pytest.raises(Exception, match="t_index is NULL"):
        sustained_risk(df, "score").collect()


def test_null_groups_stay(spark):
    rows = [(g, i, i % 2, i / 10) for g in (None, "a") for i in range(6)]
    df = spark.createDataFrame(rows, "g string, i int, y int, s double")
    assert rank_within(df, ["g"], ["i"], "r").count() == 12
    assert running_totals(df.withColumn("n", F.lit(1)), ["g"], "i", ["n"]).count() == 12
    auc = {r["g"]: r["roc_auc"] for r in gr.roc_auc(df, "s", "y", ["g"]).collect()}
    assert auc[None] == auc["a"] is not None
    assert gr.threshold_sweep(df, "s", "y", ["g"]).filter("g IS NULL").count() == 6


def test_a_nan_score_is_refused(spark):
    df = spark.createDataFrame([(0.1, 0), (float("nan"), 1), (0.3, 1)], "s double, y int")
    for run in (lambda: gr.alarm_set(df, "s"), lambda: gr.roc_auc(df, "s", "y").collect()):
        with pytest.raises(Exception, match="NaN"):
            run()


def test_scoped_tables_go_and_kept_ones_outlive_the_block(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.range(100).selectExpr("id", "id % 2 AS y", "rand(1) AS s")
    with scope():
        with scope():
            inner = stored(df, "inner")
            result = kept(inner.filter("y = 1"), "outer")
            assert inner.count() == 100
            assert gr.auc_of(df, "s", "y") is not None
        assert result.count() == 50
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_a_model_search_leaves_no_table(spark, readings):
    from fleetwise.learn import training as tr
    from fleetwise.learn.contenders import logreg_model

    folder = shared_folder(spark).removeprefix("file:")
    some = readings.filter("unit_id <= 30").select(*DEFAULT.key, *SIGNALS, DEFAULT.target)
    before = set(os.listdir(folder))
    with scope():
        assert len(tr.param_search("logreg", some, SIGNALS, trials=2, folds=2)) == 2
        assert tr.grouped_cv_auc(logreg_model(), some, SIGNALS, folds=2) is not None
    assert set(os.listdir(folder)) == before


def test_the_drift_test_is_the_callers_choice(spark, readings):
    shifted = readings.withColumn("egt_c", F.col("egt_c") * 1.3)
    by = {t: dr.feature_drift(readings, shifted, test=t).toPandas().set_index("signal") for t in ("wasserstein", "ks")}
    for t, got in by.items():
        assert set(got["test"]) == {t}
        assert got.loc["egt_c", "drifted"] and got["drifted"].sum() == 1
    with pytest.raises(ValueError):
        dr.feature_drift(readings, shifted, test="other")


def test_pages_by_key_reach_every_row_once(spark):
    df = spark.createDataFrame([(f"u{i % 3}", i, {}) for i in range(50)], "unit_id string, t_index int, readings map<string,double>")
    seen, after = [], None
    while rows := page_of(df, limit=7, after=after).collect():
        seen += [(r["unit_id"], r["t_index"]) for r in rows]
        after = seen[-1]
    assert seen == sorted((f"u{i % 3}", i) for i in range(50))
    assert page_of(df, limit=1000).count() == 50


def test_a_tight_cluster_does_not_pull_the_robust_shape(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (3000, 9))
    rows[:240] = 20 + rng.normal(0, 0.1, (240, 9))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{s} double" for s in SIGNALS))
    got = jt.RobustDistance().fit(df).transform(df).toPandas().sort_values("i")["distance"].to_numpy()
    assert np.median(got[:240]) > 10 * np.quantile(got[240:], 0.97)


def test_rare_rows_are_repeated_to_balance(spark):
    df = spark.createDataFrame([(float(i), float(i < 70)) for i in range(1000)], "x double, y double")
    got = {r["y"]: r["count"] for r in repeated(df, "y", Profile(1000, 70, {}), 1).groupBy("y").count().collect()}
    assert got[0.0] == 930 and abs(got[1.0] - 930) < 45

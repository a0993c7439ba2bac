"""States that merge: grades by counts, drift by quantile sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwise.operators import drift as dr
from fleetwise.operators import grading as gr
from fleetwise.shared import remove
from fleetwise.sources.grades import GradeStore
from fleetwise.sources.sketches import SIZE, SketchStore, rank_error, sketch_distances, slice_sketches, merged
from fleetwise.spec import DEFAULT, SIGNALS

KIND = "g string, s double, y int"


def some(n, seed):
    draw = random.Random(seed)
    values = [(draw.choice(["a", "b", None]), draw.choice([round(draw.random(), 2), draw.uniform(-1, 2)])) for _ in range(n)]
    return [(g, s, int(draw.random() < 0.3)) for g, s in values]


def as_map(df, column):
    return {r["g"]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Four batches, a base after three, one batch twice; and all rows in one table."""
    parts = [some(400, i) for i in range(4)]
    store = GradeStore(spark, str(tmp_path_factory.mktemp("grades")), ["g"])
    store.add("0", spark.createDataFrame(parts[3], KIND), "s", "y")  # wrong rows, replaced below
    for i, part in enumerate(parts):
        store.add(str(i), spark.createDataFrame(part, KIND), "s", "y")
        if i == 2:
            store.compact()
    return store, spark.createDataFrame([r for p in parts for r in p], KIND)


def test_metrics_equal_those_of_all_rows(filled):
    store, rows = filled
    for ours, whole, column in (
        (store.roc_auc(), gr.roc_auc(rows, "s", "y", ["g"]), "roc_auc"),
        (store.average_precision(), gr.average_precision(rows, "s", "y", ["g"]), "average_precision"),
    ):
        got, want = as_map(ours, column), as_map(whole, column)
        assert set(got) == {"a", "b", None}
        assert got == pytest.approx(want, abs=1e-12)
    key = lambda r: (r["g"] or "", r["threshold"])
    got = sorted(store.threshold_sweep().collect(), key=key)
    want = sorted(gr.threshold_sweep(rows, "s", "y", ["g"]).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    mine = {r["bin"]: r for r in store.calibration().where("g = 'a'").collect()}
    for r in gr.calibration(rows.where("g = 'a'"), "s", "y").collect():
        assert mine[r["bin"]]["n"] == r["n"]
        assert mine[r["bin"]]["mean_predicted"] == pytest.approx(r["mean_predicted"])
        assert mine[r["bin"]]["observed_rate"] == pytest.approx(r["observed_rate"])


@pytest.mark.parametrize("budget", [0.0005, 0.02, 0.3, 0.5, 1.0])
def test_alarm_cuts_equal_those_of_all_rows(filled, budget):
    store, rows = filled
    got = as_map(store.alarm_cuts(budget), "alarm_cut")
    for g in ("a", "b", None):
        assert got[g] == gr.alarm_cut(rows.where(F.col("g").eqNullSafe(g)), "s", budget), g


def test_a_tie_at_the_top_overflows_the_budget(spark, tmp_path):
    store = GradeStore(spark, str(tmp_path))
    store.add("x", spark.createDataFrame([("a", 0.9, 1)] * 30 + [("a", 0.1, 0)] * 70, KIND), "s", "y")
    assert [r["alarm_cut"] for r in store.alarm_cuts(0.02).collect()] == [None]
    assert [r["alarm_cut"] for r in store.alarm_cuts(0.3).collect()] == [0.9]
    assert [r["alarm_cut"] for r in store.alarm_cuts(1.0).collect()] == [0.1]


def test_a_folded_batch_is_refused_and_a_broken_one_does_not_count(spark, tmp_path):
    store = GradeStore(spark, str(tmp_path))
    store.add("x", spark.createDataFrame(some(50, 1), KIND), "s", "y")
    store.compact()
    with pytest.raises(ValueError, match="part of a base"):
        store.add("x", spark.createDataFrame(some(50, 2), KIND), "s", "y")
    store.add("y", spark.createDataFrame(some(50, 3), KIND), "s", "y")
    assert store.roc_auc().first()["n_rows"] == 100
    remove(spark, f"{tmp_path}/index/batch=y/_SUCCESS")
    assert store.roc_auc().first()["n_rows"] == 50


def test_the_store_guards_its_names_and_knows_when_it_is_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="columns of the store"):
        GradeStore(spark, str(tmp_path), ["score"])
    with pytest.raises(ValueError, match="no batch"):
        GradeStore(spark, str(tmp_path / "none")).counts()
    store = GradeStore(spark, str(tmp_path / "empty"))
    store.add("x", spark.createDataFrame([(None, None, 1)], KIND), "s", "y")  # no score, so no row
    assert store.counts().count() == 0


# -- sketches ------------------------------------------------------------------------------------


def test_distances_stay_within_the_stated_error(spark, readings):
    halves = [readings.where(f"unit_id % 2 = {i}") for i in range(2)]
    halves[1] = halves[1].withColumn("egt_c", F.col("egt_c") * 1.1).withColumn("def_level_pct", F.lit(None).cast("double"))
    week = F.floor(F.col("timestamp_h") / 168)
    sides = [merged(slice_sketches(h, week)) for h in halves]
    got = {r["signal"]: r for r in sketch_distances(*sides).collect()}
    want = {r["signal"]: r for r in dr.distances(*halves).collect()}
    assert set(got) == set(SIGNALS)
    for s in SIGNALS:
        a, b = got[s], want[s]
        assert (a["n_ref"], a["n_cur"]) == (b["n_ref"], b["n_cur"])
        assert a["ref_std"] == pytest.approx(b["ref_std"], rel=1e-9)
        if b["ks"] is None:
            assert a["ks"] is None and not a["drifted"] and not a["certain"]
            continue
        assert abs(a["ks"] - b["ks"]) <= a["ks_error"] < 0.006
        assert abs(a["wasserstein"] - b["wasserstein"]) <= a["wasserstein_error"]
        if a["certain"]:
            assert a["drifted"] == (b["wasserstein_norm"] >= dr.DISTANCE_CUT)
    assert got["egt_c"]["drifted"] and rank_error(SIZE) < 0.002


def test_any_two_periods_and_batches_twice(spark, readings, tmp_path):
    week = F.floor(F.col("timestamp_h") / 168)
    store = SketchStore(spark, str(tmp_path / "kept"), week)
    few = readings.where("unit_id <= 20")
    store.add("a", few.where("unit_id <= 5"))
    store.add("a", few.where("unit_id <= 10"))
    store.add("b", few.where("unit_id > 10"))
    got = {r["signal"]: r for r in store.drift((0, 2), (2, 4)).collect()}
    first, second = few.where("timestamp_h < 336"), few.where("timestamp_h >= 336 AND timestamp_h < 672")
    for r in dr.distances(first, second).collect():
        a = got[r["signal"]]
        assert (a["n_ref"], a["n_cur"]) == (r["n_ref"], r["n_cur"])
        assert abs(a["ks"] - r["ks"]) <= a["ks_error"]


def test_a_stream_keeps_the_sketches(spark, readings, tmp_path):
    source, few = str(tmp_path / "in"), readings.where("unit_id <= 4").select(*DEFAULT.key, "timestamp_h", *SIGNALS)
    store = SketchStore(spark, str(tmp_path / "kept"), F.floor(F.col("timestamp_h") / 168))
    for i in range(2):
        few.where(f"t_index % 2 = {i}").write.mode("append").parquet(source)
        store.watch(spark.readStream.schema(few.schema).parquet(source), str(tmp_path / "cp")).awaitTermination()
    n = {r["signal"]: r["n"] for r in store.period(0, 10**6).collect()}
    assert n == {s: few.where(f"{s} IS NOT NULL").count() for s in SIGNALS}


def test_spread_survives_a_large_mean(spark):
    draw = np.random.default_rng(1)
    rows = [(1, i, float(i), *[float(1e9 + v)] * len(SIGNALS)) for i, v in enumerate(draw.normal(0, 1, 500))]
    df = spark.createDataFrame(rows, ["unit_id", "t_index", "timestamp_h", *SIGNALS])
    out = merged(slice_sketches(df, F.floor(F.col("timestamp_h") / 50))).first()
    values = np.array([r[3] for r in rows])
    assert (out["spread"] / out["n"]) ** 0.5 == pytest.approx(values.std(), rel=1e-6)

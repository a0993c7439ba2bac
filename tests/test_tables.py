"""Guards, batches, stored runs, the log, the gate and header matching."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.functions.scalars import plain_name
from fleetwise.operators import headers as hd
from fleetwise.operators import projection as pj
from fleetwise.operators import rollup as ru
from fleetwise.operators import splits as sp
from fleetwise.plans import promotion as pm
from fleetwise.sources import predictions as pr
from fleetwise.sources import readings as src
from fleetwise.sources.runs import EVENT_SCHEMA, RunStore, evictable
from fleetwise.spec import DEFAULT, SIGNALS

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def fleet(spark, units=2, rows=5):
    df = spark.range(units * rows).select(
        F.floor(F.col("id") / rows).cast("bigint").alias("unit_id"),
        (F.col("id") % rows).cast("int").alias("t_index"),
        *[(F.col("id") + i * 100.0).alias(s) for i, s in enumerate(SIGNALS)],
    )
    return df.withColumn("egt_c", F.when(F.col("unit_id") > 0, F.col("egt_c")))


# -- guards and batches --------------------------------------------------------------------------


def test_leakage_guard_fires():
    pj.assert_no_leakage(SIGNALS)
    for c in DEFAULT.label_side:
        with pytest.raises(pj.Leakage):
            pj.assert_no_leakage([*SIGNALS, c])
    for c in ("time_to_failure_h", "failure_mode__bearing"):
        with pytest.raises(pj.Leakage):
            pj.assert_honest([*SIGNALS, c])


def test_a_missing_signal_fails_loudly(spark):
    with pytest.raises(KeyError, match="egt_c"):
        pj.select_features(fleet(spark).drop("egt_c"))


def test_projection_reaches_the_scan(readings):
    plan = pj.select_features(readings.filter("failure_within_h = 1"), keep=["unit_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(failure_within_h,1)" in text
    assert "anomaly_type" not in text.split("ReadSchema")[1]


def test_nan_becomes_null_at_load(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    pdf = fleet(spark).drop("t_index").toPandas()
    pdf["timestamp_h"] = pdf["engine_speed_rpm"] % 5 * 2.0
    pdf.loc[0, "coolant_temp_c"] = np.nan
    pdf.to_parquet(path)
    got = src.load_readings(spark, path, labelled=False)
    assert got.filter("coolant_temp_c IS NULL").count() == 1
    assert got.filter(F.isnan("coolant_temp_c")).count() == 0
    by_unit = got.groupBy("unit_id").agg(F.sort_array(F.collect_list("t_index")).alias("t"))
    assert {tuple(r["t"]) for r in by_unit.collect()} == {(0, 1, 2, 3, 4)}
    with pytest.raises(KeyError):
        src.load_readings(spark, path)


def test_partial_upload(spark, tmp_path):
    path = str(tmp_path / "batch.csv")
    pd.DataFrame({"RPM": [1500, "broken"], "Coolant Temp": [88.5, 90]}).to_csv(path, index=False)
    batch = src.read_batch(spark, path)
    mapping = hd.suggest_mapping(spark, batch.columns)
    assert mapping["engine_speed_rpm"] == "RPM" and mapping["egt_c"] is None
    got = pj.coerce_numeric(batch, mapping).toPandas()
    assert list(got.columns) == list(SIGNALS)
    assert got["engine_speed_rpm"].isna().tolist() == [False, True]
    assert got[list(SIGNALS[2:])].isna().all().all()
    pj.assert_scorable(pj.coerce_numeric(batch, mapping), mapping)


def test_unusable_batches_are_refused(spark, tmp_path):
    words = str(tmp_path / "words.csv")
    pd.DataFrame({"a": ["x", "y"]}).to_csv(words, index=False)
    empty = str(tmp_path / "empty.csv")
    pd.DataFrame({"a": []}).to_csv(empty, index=False)
    for path in (words, empty, str(tmp_path / "batch.xlsx")):
        with pytest.raises(pj.Unscorable):
            src.read_batch(spark, path)
    df = spark.createDataFrame([("x",)], "a string")
    none = pj.resolve_mapping(df.columns, {})
    with pytest.raises(pj.Unscorable):
        pj.assert_scorable(pj.coerce_numeric(df, none), none)
    text = pj.resolve_mapping(df.columns, {"egt_c": "a", "coolant_temp_c": "gone"})
    assert text["coolant_temp_c"] is None
    with pytest.raises(pj.Unscorable):
        pj.assert_scorable(pj.coerce_numeric(df, text), text)


def test_sample_round_trip(spark, readings, tmp_path):
    path = str(tmp_path / "sample")
    src.write_sample(readings, path)
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["coolant_temp_c"] == "float" and back.count() == readings.count()


# -- stored runs ---------------------------------------------------------------------------------


@pytest.fixture()
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def test_null_survives_the_store(spark, store):
    assert store.append_readings("r", fleet(spark)) == 10
    assert store.readings("r").filter("egt_c IS NULL").count() == 5
    page = store.page("r", offset=4, limit=2).toPandas()
    assert page[["unit_id", "t_index"]].values.tolist() == [["0", 4], ["1", 0]]
    assert store.page("r", offset=-5, limit=10_000).count() == 10
    with pytest.raises(KeyError):
        store.append_readings("r", fleet(spark).drop("egt_c"))


def test_only_the_wanted_run_is_read(spark, store):
    for r in ("a", "b"):
        store.append_readings(r, fleet(spark))
    plan = store.readings("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_run_states(store):
    store.create_run("r", 3, 7, 42, at=START)
    assert store.runs().first()["status"] == "queued"
    store.mark_running("r", at=START + timedelta(seconds=5))
    store.mark_failed("r", "x" * 900, at=START + timedelta(seconds=9))
    row = store.runs().first()
    assert row["status"] == "failed" and len(row["error"]) == 500 and row["n_units"] == 3
    assert row["finished_at"] > row["started_at"] > row["created_at"]


def finished_runs(spark, store):
    for i, run in enumerate(("old", "middle", "new")):
        store.create_run(run, 2, 1, 42, at=START + timedelta(minutes=i))
        store.mark_succeeded(run, 60, at=START + timedelta(minutes=i, seconds=1))
        store.append_readings(run, fleet(spark, 2, 30))


def test_oldest_runs_go_first(spark, store):
    finished_runs(spark, store)
    assert store.total_readings() == 180
    assert store.prune(100) == 2
    assert [r["run_id"] for r in store.runs().collect()] == ["new"]
    assert store.total_readings() == 60 and store.prune(100) == 0


def test_kept_and_running_runs_stay(spark, store):
    finished_runs(spark, store)
    store.create_run("live", 2, 1, 42, at=START - timedelta(days=1))
    store.append_readings("live", fleet(spark, 2, 30))
    assert store.prune(0, keep=["old"]) == 2
    assert {r["run_id"] for r in store.runs().collect()} == {"old", "live"}
    assert store.count_readings("live") == 60


def test_evictable_ignores_the_budget_when_it_fits(spark):
    runs = spark.createDataFrame(
        [("a", "succeeded", START, 50)], "run_id string, status string, created_at timestamp, n_rows long"
    )
    assert evictable(runs, 50).count() == 0
    assert EVENT_SCHEMA.fieldNames()[0] == "run_id"


def test_report_is_kept_per_model_version(spark, store):
    rollup = ru.unit_rollup(
        fleet(spark, 3, 4).withColumn("p", F.col("unit_id") / 4.0), "p"
    )
    store.save_report("r", "1", rollup)
    store.save_report("r", "1", rollup)
    assert [r["unit_id"] for r in store.load_report("r", "1").collect()] == ["2", "1", "0"]
    assert store.load_report("r", "2").count() == 0
    store.save_report("r", "2", rollup)
    assert store.load_report("r", "1").count() == 3


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    df = fleet(spark).withColumn("p", F.col("t_index") / 10.0)
    at = F.timestamp_seconds(F.col("unit_id") * 100 + F.col("t_index"))
    wide = F.create_map(F.lit("egt_c"), F.col("egt_c"), F.lit("name"), F.lit(1.0))
    pr.log_predictions(df, path, "p", 3, created_at=at, readings=wide)
    got = pr.recent_predictions(spark, path, 2).toPandas()
    assert got["failure_probability"].tolist() == [0.4, 0.3]
    assert got["model_version"].tolist() == ["3", "3"]
    assert set(got["readings"].iloc[0]) == set(SIGNALS)


# -- the gate ------------------------------------------------------------------------------------

REQUESTS = "name string, seq long, version long, roc_auc double, forced boolean"
LIVE = "name string, live_version long, live_auc double"


@pytest.mark.parametrize(
    "auc, delta, forced, promoted, reason",
    [
        (0.81, 0.0, False, True, "passed"),
        (0.79, 0.0, False, False, "rejected"),
        (0.80, 0.0, False, True, "passed"),
        (0.79, 0.02, False, True, "passed"),
        (0.10, 0.0, True, True, "forced"),
        (None, 0.0, False, False, "no_metric"),
    ],
)
def test_gate(spark, auc, delta, forced, promoted, reason):
    live = spark.createDataFrame([("m", 1, 0.80)], LIVE)
    got = pm.gate(spark.createDataFrame([("m", 2, 2, auc, forced)], REQUESTS), live, delta).first()
    assert (got["promoted"], got["reason"]) == (promoted, reason)


def test_gate_first_and_same(spark):
    asked = spark.createDataFrame([("m", 1, 1, 0.7, False), ("n", 1, 4, 0.6, False)], REQUESTS)
    live = spark.createDataFrame([("n", 4, 0.6)], LIVE)
    got = {r["name"]: r["reason"] for r in pm.gate(asked, live).collect()}
    assert got == {"m": "first", "n": "same"}


def replay(rows, min_delta=0.0):
    """The gate one request at a time, as the checking recurrence."""
    live, out = {}, []
    for name, seq, version, auc, forced in sorted(rows, key=lambda r: (r[0], r[1])):
        before = live.get(name)
        if auc is None:
            ok, why = False, "no_metric"
        elif forced:
            ok, why = True, "forced"
        elif before is None:
            ok, why = True, "first"
        elif before[0] == version:
            ok, why = True, "same"
        else:
            ok = auc >= before[1] - min_delta
            why = "passed" if ok else "rejected"
        if ok:
            live[name] = (version, auc)
        out.append((name, seq, before[0] if before else None, ok, why))
    return out


def test_history_matches_one_at_a_time(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        name = "hot" if rng.random() < 0.5 else f"m{rng.integers(5)}"
        auc = None if rng.random() < 0.05 else float(rng.integers(60, 90)) / 100
        rows.append((name, i, i, auc, bool(rng.random() < 0.05)))
    got = pm.promotion_history(spark.createDataFrame(rows, REQUESTS))
    got = sorted(
        (r["name"], r["seq"], r["incumbent_version"], r["promoted"], r["reason"]) for r in got.collect()
    )
    assert got == sorted(replay(rows), key=lambda r: r[:2])


@pytest.mark.parametrize("min_delta", [0.0, 0.01, 0.045, 5.0])
def test_tolerant_history_matches_one_at_a_time(spark, min_delta):
    """Falling, rising and mixed runs of one name over many blocks."""
    rng = np.random.default_rng(9)
    falling = [0.9 - i / 500 for i in range(300)]
    metrics = {
        "hot": list(rng.integers(600, 900, 600) / 1000),
        "falls": falling,
        "rises": falling[::-1],
        "none": [None] * 40,
        None: list(rng.random(50)),
    }
    rows = []
    for name, values in metrics.items():
        for i, auc in enumerate(values):
            auc = None if auc is None or rng.random() < 0.05 else float(auc)
            rows.append((name, i, i, auc, bool(rng.random() < 0.01)))
    df = spark.createDataFrame(rows, REQUESTS).repartition(3)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # small blocks would else become one
    try:
        parts = df.repartitionByRange("name", "seq").select("name", F.spark_partition_id().alias("part")).distinct()
        assert parts.filter("name = 'hot'").count() > 2
        got = pm.promotion_history(df, min_delta).collect()
    finally:
        spark.conf.unset(setting)
    key = lambda r: (r[0] or "", r[1])
    got = sorted(((r["name"], r["seq"], r["incumbent_version"], r["promoted"], r["reason"]) for r in got), key=key)
    want = []
    for name in metrics:  # a NULL name is a name
        part = [("", *r[1:]) for r in rows if r[0] == name]
        want += [(name, *r[1:]) for r in replay(part, min_delta)]
    assert got == sorted(want, key=key)


def test_tolerant_history_of_nothing(spark):
    empty = spark.createDataFrame([], REQUESTS)
    assert pm.promotion_history(empty, 0.1).count() == 0
    for wrong in (-0.1, float("nan"), float("inf")):
        with pytest.raises(pm.PromotionError):
            pm.promotion_history(empty, wrong)


def test_a_metric_that_is_no_number_is_none(spark):
    rows = [("m", 1, 1, 0.7, False), ("m", 2, 2, float("nan"), True), ("m", 3, 3, 0.65, False)]
    got = pm.promotion_history(spark.createDataFrame(rows, REQUESTS), 0.1).orderBy("seq").collect()
    assert [r["reason"] for r in got] == ["first", "no_metric", "passed"]
    assert got[2]["incumbent_version"] == 1


def test_roll_back(spark):
    rows = [("m", 1, 1, 0.7, False), ("m", 2, 2, 0.8, False), ("m", 3, 3, 0.6, False), ("n", 1, 1, 0.5, False)]
    decisions = pm.promotion_history(spark.createDataFrame(rows, REQUESTS))
    assert pm.roll_back(decisions, "m") == 1
    for name in ("n", "unknown"):
        with pytest.raises(pm.PromotionError):
            pm.roll_back(decisions, name)


# -- splits --------------------------------------------------------------------------------------


def test_split_is_disjoint_and_repeatable(readings):
    first = sp.unit_sides(readings).toPandas().sort_values("unit_id")
    again = sp.unit_sides(readings.repartition(5)).toPandas().sort_values("unit_id")
    assert first["split"].tolist() == again["split"].tolist()
    assert (first["split"] == "test").sum() == 25
    assert sp.split_overlap(sp.grouped_split(readings)).count() == 0
    assert sp.unit_sides(readings, seed=7).toPandas()["split"].tolist() != first["split"].tolist()


def test_folds_are_even(readings):
    sizes = sp.fold_units(readings).groupBy("fold").agg(F.sum("n_rows").alias("n")).toPandas()["n"]
    assert len(sizes) == 5 and sizes.max() < 1.02 * sizes.min()


def test_missing_modes_are_reported(readings):
    sp.mode_coverage(readings, strict=True)
    with pytest.raises(sp.MissingMode, match="bearing"):
        sp.mode_coverage(readings.filter("failure_mode <> 'bearing'"), strict=True)
    classes = readings.select("unit_id", F.lit(1).alias("c")).distinct()
    modes = sp.unit_event_mode(readings)
    picked = sp.stratified_units(modes, classes, "c").groupBy("event_mode").count().collect()
    assert {r["event_mode"]: r["count"] for r in picked} == sp.QUOTAS
    with pytest.raises(sp.MissingMode):
        sp.stratified_units(modes.filter("unit_id < 20"), classes, "c")


# -- headers -------------------------------------------------------------------------------------

MESSY = ["RPM", "Coolant Temp", "oil_press", "Load%", "fuel", "boost", "EGT", "DEF", "vibration", "unrelated_col"]


def faults(headers, proposal, score):
    """What is wrong with a proposal, said without building one."""
    out, used = [], [h for h in proposal.values() if h is not None]
    if len(used) != len(set(used)):
        out.append("a header is used twice")
    for s, h in proposal.items():
        own = score[s, h] if h is not None else 0.6
        if h is not None and own < 0.6:
            out.append(f"{s}: {h} is below the cut")
        for other in headers:
            holder = next((t for t, g in proposal.items() if g == other), None)
            theirs = score[holder, other] if holder else -1.0
            if score[s, other] > own + 1e-12 and score[s, other] > theirs + 1e-12 and score[s, other] >= 0.6:
                out.append(f"{s} and {other} would both rather have each other")
    return out


def test_messy_headers(spark):
    got = hd.suggest_mapping(spark, MESSY)
    assert got == dict(zip(SIGNALS, MESSY))


def test_no_pair_beats_an_assigned_one(spark):
    rng = np.random.default_rng(8)
    words = [*SIGNALS, *MESSY, "oil_pressure", "boost_press", "coolant_temperature", "engine", "load_pct",
             "vibration_mm", "def_level", "EGT_C", "temp", "fuel_rate", "pressure_kpa", "speed", "", "Öl-Druck"]
    files = {
        f: list(dict.fromkeys(rng.choice(words, rng.integers(1, 25)).tolist())) for f in range(40)
    }
    rows = [(f, h, i) for f, hs in files.items() for i, h in enumerate(hs)]
    catalogue = spark.createDataFrame(rows, "file int, header string, position int")
    for ratio in ("edit", "matching"):
        scores = hd.pair_scores(catalogue, "header", ratio=ratio)
        score = {(r["signal"], r["header"]): r["score"] for r in scores.collect()}
        got = {f: {s: None for s in SIGNALS} for f in files}
        for r in hd.match_headers(catalogue, "file", "header", "position", ratio=ratio).collect():
            got[r["file"]][r["signal"]] = r["header"]
        assert {f: faults(hs, got[f], score) for f, hs in files.items()} == {f: [] for f in files}


def test_plain_names_keep_other_alphabets(spark):
    df = spark.createDataFrame([("Engine RPM-1",), ("Öl_Druck",)], "x string")
    assert [r[0] for r in df.select(plain_name(F.col("x"))).collect()] == ["enginerpm1", "öldruck"]


def test_headers_are_scored_without_reading_the_files_again(spark, tmp_path):
    from fleetwise.operators.headers import match_headers, pair_scores

    files = str(tmp_path / "catalogue_of_files")
    spark.createDataFrame([(1, "rpm", 0), (1, "rpm", 1), (1, None, 2), (2, "zzzz", 0)], "f int, h string, p int").write.parquet(files)
    catalogue = spark.read.parquet(files)
    plan = pair_scores(catalogue, "h")._jdf.queryExecution().executedPlan().toString()
    assert "catalogue_of_files" not in plan
    assert [tuple(r) for r in match_headers(catalogue, "f", "h", "p").collect()] == [(1, "engine_speed_rpm", "rpm", 0.95)]


def test_stored_runs_are_not_sorted_by_run(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from fleetwise.sources.runs import RunStore

    store, name = RunStore(spark, str(tmp_path / "runs")), "spark.sql.maxConcurrentOutputFileWriters"
    before, seen, write = spark.conf.get(name), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (seen.append(spark.conf.get(name)), write(*a, **k)))
    rows = spark.range(200).selectExpr("'u' unit_id", "CAST(id AS INT) t_index", "map('egt_c', 1D) readings", "CASE WHEN id % 20 > 0 THEN concat('run-', id % 20) END run_id")
    store.append_packed(rows)
    assert int(seen[-1]) >= 16 and spark.conf.get(name) == before
    assert sorted(r.n_rows for r in store.counts().collect()) == [10] * 20

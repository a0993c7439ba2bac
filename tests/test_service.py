import pytest
from pyspark.sql import functions as F

from fleetwise.learn.contenders import BUILDERS
from fleetwise.operators import projection as pj
from fleetwise.operators.rollup import unit_rollup
from fleetwise.operators.aggregates import DataQualitySpike
from fleetwise.plans import service as sv
from fleetwise.plans.promotion import PromotionError, PromotionLog
from fleetwise.queries.base import SCORE
from fleetwise.sources.runs import RunStore
from fleetwise.spec import DEFAULT, SIGNALS

scorer = lambda df: df.withColumn("score", F.expr(SCORE))


def test_a_file_is_scored_end_to_end(spark, readings, tmp_path):
    path = str(tmp_path / "batch.csv")
    names = ["RPM", "Coolant Temp", "oil_press", "Load%", "fuel", "boost", "EGT", "DEF", "vibration"]
    some = readings.filter("unit_id = 3")
    some.select(*[F.col(s).alias(n) for s, n in zip(SIGNALS, names)]).write.option("header", True).csv(path)
    got = sv.score_file(spark, path, scorer, "score")
    assert got.mapping == dict(zip(SIGNALS, names))
    assert got.scored.count() == some.count()
    want = scorer(some).agg(F.count_if(F.col("score") >= 0.5)).first()[0]
    assert want in got.summary.first()[:]
    with pytest.raises(pj.Unscorable):
        sv.score_file(spark, path, scorer, "score", wanted={"egt_c": "absent"})


def test_a_report_is_made_once(spark, readings, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.append_readings("r", readings.filter("unit_id < 4"))
    calls = []
    count = lambda df: (calls.append(1), scorer(df))[1]
    first, known = sv.run_report(store, "r", "1", count, "score")
    rows = first.collect()
    again, known_again = sv.run_report(store, "r", "1", count, "score")
    assert (known, known_again, len(calls)) == (False, True, 1) and again.collect() == rows
    want = {str(r["unit_id"]): r["risk"] for r in unit_rollup(scorer(readings.filter("unit_id < 4")), "score").collect()}
    assert {r["unit_id"]: r["risk"] for r in rows} == pytest.approx(want)
    assert not sv.run_report(store, "r", "2", count, "score")[1]


def test_the_watcher_trips_on_bad_readings_only(readings):
    good = readings.select(*DEFAULT.key, *SIGNALS)
    watcher = sv.quality_watcher(good, trees=50)
    assert 0 <= watcher.baseline < 0.2
    assert not watcher.check(good).first()["tripped"]
    bad = good.withColumns({s: F.lit(1e6) + F.rand(3) for s in SIGNALS[:6]})
    verdict = watcher.check(bad).first()
    assert verdict["suspect_rate"] > 0.5 and verdict["tripped"] == (verdict["suspect_rate"] > 3 * watcher.baseline)
    if verdict["tripped"]:
        with pytest.raises(DataQualitySpike):
            watcher.check(bad, strict=True)


def test_search_feeds_training(readings):
    some = readings.filter("unit_id <= 40")
    tuned, result = sv.search_and_train(some, trials=1, folds=2, trees=20, names=("logreg",))
    assert set(tuned) == {"logreg"} and set(tuned["logreg"]) == {"C"}
    assert result.models["logreg"].features[-1] == "signal_suspect" or len(result.features) == len(SIGNALS) + 1
    assert set(result.models) == set(BUILDERS)


def test_the_gate_with_a_tolerance_and_the_way_back(spark, tmp_path):
    log = PromotionLog(spark, str(tmp_path / "log"))
    ask = lambda *rows: spark.createDataFrame(
        [(n, s, v, a, f) for n, s, v, a, f in rows], "name string, seq bigint, version bigint, roc_auc double, forced boolean"
    )
    live = lambda: {r["name"]: r["live_version"] for r in log.live().collect()}
    log.publish(ask(("m", 1, 1, 0.80, False), ("k", 1, 7, 0.5, False)), 0.02)
    assert live() == {"m": 1, "k": 7}
    log.publish(ask(("m", 2, 2, 0.79, False)), 0.02)
    log.publish(ask(("m", 3, 3, 0.775, False)), 0.02)  # against the live 0.79, not the best 0.80
    assert live()["m"] == 3
    log.publish(ask(("m", 4, 4, 0.70, False)), 0.02)
    assert live()["m"] == 3
    assert log.roll_back("m") == 2 and live()["m"] == 2
    reasons = [r["reason"] for r in log.decisions().filter("name = 'm'").orderBy("batch").collect()]
    assert reasons == ["first", "passed", "passed", "rejected", "rolled_back"]
    with pytest.raises(PromotionError):
        log.roll_back("k")
    with pytest.raises(PromotionError):
        log.publish(ask(("m", 5, 5, 0.9, False), ("m", 6, 6, 0.9, False)))

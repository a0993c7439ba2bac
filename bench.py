"""Times the headline queries and prints one JSON line.

Every query is run to its full result, without bringing rows to the driver. The readings table is
derived once before the clock starts on the others; its own time is reported as ``derive_readings``.
Some operators are timed without the rounding that their registered queries add for the comparison, and
fitting apart from scoring: ``fit_logreg`` splits, writes and fits, ``score_batch`` scores all rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "load_readings",
    "temporal_features",
    "monotone_window",
    "stuck_blocks",
    "equal_run",
    "temporal_detector",
    "sustained_risk",
    "unit_rollup",
    "fleet_report",
    "signal_medians",
    "signal_moments",
    "roc_auc",
    "average_precision",
    "alarm_set",
    "score_ladder",
    "auc_by_horizon",
    "compare_rollups",
    "grouped_split",
    "grouped_folds",
    "drift_decision",
    "append_run_readings",
    "score_stream",
    "reconstruction_detector",
    "fit_logreg",
    "score_batch",
)
PER_SECOND = ("score_batch", "unit_rollup")


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from fleetwise.operators import rollup, windows
    from fleetwise.queries import REGISTRY
    from fleetwise.queries.base import scored
    from fleetwise.learn import contenders, training
    from fleetwise.sources.stand_in import readings
    from fleetwise.spec import DEFAULT, SIGNALS

    fitted = {}

    def fit(s, d):
        frame = training.prepare(readings(s, d))[0]
        fitted["logreg"] = contenders.logreg_model().fit(training.side(frame, "train"), SIGNALS)
        return s.range(1)

    def score(s, d):
        if not fitted:
            fit(s, d)
        return fitted["logreg"].score(readings(s, d).select(*DEFAULT.key, *SIGNALS))

    bare = {
        "fit_logreg": fit,
        "score_batch": score,
        "temporal_features": lambda s, d: windows.temporal_features(readings(s, d)),
        "sustained_risk": lambda s, d: rollup.sustained_risk(scored(s, d), "score"),
    }

    wanted = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in HEADLINE if wanted == [""] or n in wanted]
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    started = time.perf_counter()
    n_rows = readings(spark, sf_dir).count()
    times = {"derive_readings": round(time.perf_counter() - started, 3)}
    for name in names:
        started = time.perf_counter()
        run = bare.get(name) or REGISTRY[name].run
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "rows": n_rows,
                "rows_per_second": {n: round(n_rows / times[n]) for n in PER_SECOND if n in times},
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

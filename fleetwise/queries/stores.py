"""Queries on stored runs, the prediction log and the promotion gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwise.functions.scalars import signals_from_map
from fleetwise.plans import promotion as pm
from fleetwise.queries.analysis import _ROLLUP, _SHORT, ROLLUP_SQL, rolled_up
from fleetwise.queries.analysis import _CDF, _auc_sql, _drift_frames
from fleetwise.queries.base import COLUMNS, on_readings, query, rd, rounded_columns, scored
from fleetwise.shared import new_path
from fleetwise.sources import predictions as pr
from fleetwise.sources import runs as rs
from fleetwise.sources.grades import GradeStore
from fleetwise.sources.sketches import SketchStore
from fleetwise.sources.stand_in import once, readings, table
from fleetwise.spec import SIGNALS


def _store(spark):
    return rs.RunStore(spark, new_path(spark, "store"))


def _seven_runs(spark, sf_dir):
    """The readings as seven runs in the stored form, DEF level missing from odd runs' maps."""
    df = readings(spark, sf_dir)
    number = F.col("unit_id").cast("bigint") % 7
    packed = rs.pack_readings(df).withColumn("run_id", F.concat(F.lit("run-"), number))
    slim = F.map_filter("readings", lambda k, _: k != "def_level_pct")
    return packed.withColumn("readings", F.when(number % 2 == 1, slim).otherwise(F.col("readings")))


_RUN = "'run-' || CAST(unit_id % 7 AS VARCHAR)"
_ODD = "unit_id % 7 % 2 = 1"


@query(
    "append_run_readings",
    on_readings(
        "SELECT 'whole' AS run_id, CAST(unit_id AS VARCHAR) AS unit_id, t_index, 9 AS n_keys, coolant_temp_c, egt_c FROM readings"
    ),
)
def append_run_readings(spark, sf_dir):
    store = _store(spark)
    store.append_readings("whole", readings(spark, sf_dir))
    return store.all_rows().select(
        "run_id",
        "unit_id",
        "t_index",
        F.size("readings").alias("n_keys"),
        *signals_from_map(F.col("readings"), ["coolant_temp_c", "egt_c"]),
    )


_DEF = f"CASE WHEN {_ODD} THEN NULL ELSE def_level_pct END AS def_level_pct"
_WIDE = ", ".join(_DEF if s == "def_level_pct" else s for s in SIGNALS)


@query(
    "unpack_run_readings",
    on_readings(
        f"SELECT CAST(unit_id AS VARCHAR) AS unit_id, t_index, {_WIDE} FROM readings WHERE unit_id % 7 = 3"
    ),
)
def unpack_run_readings(spark, sf_dir):
    store = _store(spark)
    store.append_packed(_seven_runs(spark, sf_dir))
    return store.readings("run-3")


@query(
    "page_readings",
    on_readings(
        f"SELECT * FROM (SELECT CAST(unit_id AS VARCHAR) AS unit_id, t_index, {_WIDE} FROM readings WHERE unit_id % 7 = 2) "
        "ORDER BY unit_id, t_index LIMIT 1000 OFFSET 150"
    ),
)
def page_readings(spark, sf_dir):
    store = _store(spark)
    store.append_packed(_seven_runs(spark, sf_dir))
    return store.page("run-2", offset=150, limit=1000)


@query(
    "count_readings",
    on_readings(f"SELECT {_RUN} AS run_id, count(*) AS n_rows FROM readings GROUP BY 1"),
)
def count_readings(spark, sf_dir):
    store = _store(spark)
    store.append_packed(_seven_runs(spark, sf_dir))
    return store.counts()


@query("total_readings", on_readings("SELECT count(*) AS n_rows FROM readings"))
def total_readings(spark, sf_dir):
    store = _store(spark)
    store.append_packed(_seven_runs(spark, sf_dir))
    return store.all_rows().agg(F.count(F.lit(1)).alias("n_rows"))


_STORED = (
    "SELECT CAST(unit_id AS VARCHAR) AS unit_id, CAST(n_rows AS INT) AS n_rows, risk, peak, high_risk_share, flagged, "
    "'whole' AS run_id, {} AS model_version FROM (" + ROLLUP_SQL + " FROM rolled)"
)


def _reported(spark, sf_dir):
    """Saved twice under version 1, the first time with wrong numbers, and once under version 2."""
    store, rollup = _store(spark), rolled_up(spark, sf_dir)
    store.save_report("whole", "1", rollup.withColumn("risk", F.lit(0.0)))
    store.save_report("whole", "2", rollup)
    store.save_report("whole", "1", rollup)
    return store


@query(
    "save_report",
    on_readings(_STORED.format("'1'") + " UNION ALL " + _STORED.format("'2'"), _SHORT, _ROLLUP),
)
def save_report(spark, sf_dir):
    store = _reported(spark, sf_dir)
    return store.load_report("whole", "1").unionByName(store.load_report("whole", "2"))


@query("load_report", on_readings(_STORED.format("'1'"), _SHORT, _ROLLUP))
def load_report(spark, sf_dir):
    return _reported(spark, sf_dir).load_report("whole", "1")


# -- run states ----------------------------------------------------------------------------------


def run_events(spark, sf_dir):
    """A state log with one run per order: open orders still run, pending ones failed."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderstatus").alias("s"),
        (
            F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
            - F.unix_seconds(F.lit("1970-01-01").cast("timestamp"))
        ).alias("at0"),
        (F.col("o_orderkey") % 50 + 1).cast("bigint").alias("n"),
        F.col("o_orderpriority").alias("p"),
    )

    def change(status, delay, n_rows, error):
        return F.struct(
            F.lit(status).alias("status"),
            F.timestamp_seconds(F.col("at0") + delay).alias("at"),
            n_rows.cast("bigint").alias("n_rows"),
            error.cast("string").alias("error"),
        )

    none = F.lit(None)
    changes = F.array_compact(
        F.array(
            change("queued", 0, F.lit(0), none),
            F.when(F.col("s") != "O", change("running", 60, none, none)),
            F.when(F.col("s") == "F", change("succeeded", 120, F.col("n"), none)),
            F.when(F.col("s") == "P", change("failed", 90, none, F.repeat(F.col("p"), F.lit(100)))),
        )
    )
    rows = orders.select("run_id", F.explode(changes).alias("c")).select("run_id", "c.*")
    return rows.select(
        "run_id",
        "status",
        "at",
        F.lit(3).alias("n_units"),
        F.lit(7).alias("days"),
        F.lit(42).alias("seed"),
        "n_rows",
        "error",
    )


_RUNS = """runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  epoch(o_orderdate) AS at0, o_orderstatus AS s, o_orderpriority AS p,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 50 + 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_rows FROM orders)"""


@query(
    "run_state",
    f"""WITH {_RUNS} SELECT run_id, status, 3 AS n_units, 7 AS days, 42 AS seed, CAST(at0 AS BIGINT) AS created_at,
  CAST(CASE WHEN s <> 'O' THEN at0 + 60 ELSE -1 END AS BIGINT) AS started_at,
  CAST(CASE s WHEN 'F' THEN at0 + 120 WHEN 'P' THEN at0 + 90 ELSE -1 END AS BIGINT) AS finished_at, n_rows,
  CASE WHEN s = 'P' THEN left(repeat(p, 100), 500) END AS error FROM runs""",
)
def run_state(spark, sf_dir):
    runs = rs.current_state(run_events(spark, sf_dir))
    return runs.withColumns(
        {
            c: F.coalesce(F.unix_seconds(c), F.lit(-1).cast("bigint"))
            for c in ("created_at", "started_at", "finished_at")
        }
    )


_BUDGET = 50_000


@query(
    "retention",
    f"""WITH {_RUNS}, sized AS (SELECT *, (SELECT sum(n_rows) FROM runs) AS total FROM runs
  WHERE status IN ('succeeded', 'failed') AND run_id <> '1'),
placed AS (SELECT *, coalesce(sum(n_rows) OVER (ORDER BY at0, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT run_id, CAST(at0 AS BIGINT) AS created_at, n_rows FROM placed WHERE total - before > {_BUDGET}""",
)
def retention(spark, sf_dir):
    runs = once(spark, sf_dir, "runs", lambda: rs.current_state(run_events(spark, sf_dir)))
    gone = rs.evictable(runs, _BUDGET, keep=["1"])
    return gone.withColumn("created_at", F.unix_seconds("created_at"))


# -- prediction log ------------------------------------------------------------------------------


def _logged(spark, sf_dir):
    path = new_path(spark, "predictions")
    wide = F.map_concat(
        F.map_from_arrays(
            F.array(*[F.lit(s) for s in SIGNALS]), F.array(*[F.col(s) for s in SIGNALS])
        ),
        F.create_map(F.lit("stranger"), F.lit(1.0)),
    )
    pr.log_predictions(
        scored(spark, sf_dir),
        path,
        "score",
        "7",
        created_at=F.timestamp_seconds(F.col("timestamp_h") * 3600 + F.col("unit_id")),
        readings=wide,
    )
    return path


_LOG = f"""logged AS (SELECT CAST(timestamp_h * 3600e0 + unit_id AS BIGINT) AS created_at, '7' AS model_version,
  score AS failure_probability, 9 AS n_keys, {COLUMNS} FROM scored)"""


def _shown(log):
    return log.select(
        F.unix_seconds("created_at").alias("created_at"),
        "model_version",
        "failure_probability",
        F.size("readings").alias("n_keys"),
        *signals_from_map(F.col("readings"), SIGNALS),
    )


@query("log_predictions", on_readings("SELECT * FROM logged", _LOG))
def log_predictions(spark, sf_dir):
    return _shown(spark.read.schema(pr.LOG_SCHEMA).parquet(_logged(spark, sf_dir)))


@query("recent_predictions", on_readings("SELECT * FROM logged ORDER BY created_at DESC LIMIT 10", _LOG))
def recent_predictions(spark, sf_dir):
    return _shown(pr.recent_predictions(spark, _logged(spark, sf_dir)))


# -- promotion -----------------------------------------------------------------------------------


def promotion_requests(spark, sf_dir):
    """A request per part: brands are model names, some requests lack a metric or are forced."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_brand").alias("name"),
        F.col("p_partkey").cast("bigint").alias("seq"),
        F.col("p_partkey").cast("bigint").alias("version"),
        F.when(F.col("p_partkey") % 29 != 3, 0.5 + (F.col("p_partkey") * 37 % 101) / 1000.0).alias("roc_auc"),
        (F.col("p_partkey") % 41 == 5).alias("forced"),
    )


_REQUESTS = """requests AS (SELECT p_brand AS name, CAST(p_partkey AS BIGINT) AS seq, CAST(p_partkey AS BIGINT) AS version,
  CASE WHEN p_partkey % 29 <> 3 THEN 0.5e0 + (p_partkey * 37 % 101) / 1000e0 END AS roc_auc, p_partkey % 41 = 5 AS forced FROM part)"""
_HISTORY = """since AS (SELECT *, sum(CASE WHEN forced AND roc_auc IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY seq) AS part FROM requests),
lives AS (SELECT *, max(CASE WHEN roc_auc IS NOT NULL THEN {'part': part, 'roc_auc': roc_auc, 'seq': seq, 'version': version} END)
  OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live FROM since),
decided AS (SELECT name, seq, version, roc_auc, forced, live.version AS incumbent_version,
  live.roc_auc AS incumbent_auc, CASE WHEN roc_auc IS NULL THEN 'no_metric' WHEN forced THEN 'forced' WHEN live IS NULL THEN 'first'
    WHEN roc_auc >= live.roc_auc THEN 'passed' ELSE 'rejected' END AS reason FROM lives)"""


@query(
    "promotion_decision",
    f"""WITH {_REQUESTS}, {_HISTORY} SELECT name, seq, version, roc_auc, forced, coalesce(incumbent_version, -1) AS incumbent_version, incumbent_auc,
  reason IN ('forced', 'first', 'passed') AS promoted, reason FROM decided""",
)
def promotion_decision(spark, sf_dir):
    out = pm.promotion_history(promotion_requests(spark, sf_dir))
    return out.fillna(-1, ["incumbent_version"])


_TOLERANCE = 0.015


# DuckDB goes through each name's requests one by one.
@query(
    "tolerant_promotion",
    f"""WITH RECURSIVE {_REQUESTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS place FROM requests),
walk AS (SELECT name, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS live_version, CAST(NULL AS DOUBLE) AS live_auc,
    CAST(NULL AS BIGINT) AS before_version, CAST(NULL AS DOUBLE) AS before_auc FROM (SELECT DISTINCT name FROM requests)
  UNION ALL SELECT w.name, n.place,
    CASE WHEN n.roc_auc IS NOT NULL AND (n.forced OR w.live_version IS NULL OR n.roc_auc >= w.live_auc - {_TOLERANCE}e0) THEN n.version ELSE w.live_version END,
    CASE WHEN n.roc_auc IS NOT NULL AND (n.forced OR w.live_version IS NULL OR n.roc_auc >= w.live_auc - {_TOLERANCE}e0) THEN n.roc_auc ELSE w.live_auc END,
    w.live_version, w.live_auc FROM walk w JOIN numbered n ON n.name = w.name AND n.place = w.place + 1),
decided AS (SELECT n.name, n.seq, n.version, n.roc_auc, n.forced, w.before_version, w.before_auc,
  CASE WHEN n.roc_auc IS NULL THEN 'no_metric' WHEN n.forced THEN 'forced' WHEN w.before_version IS NULL THEN 'first'
    WHEN n.roc_auc >= w.before_auc - {_TOLERANCE}e0 THEN 'passed' ELSE 'rejected' END AS reason
  FROM numbered n JOIN walk w ON w.name = n.name AND w.place = n.place)
SELECT name, seq, version, roc_auc, forced, coalesce(before_version, -1) AS incumbent_version, before_auc AS incumbent_auc,
  reason IN ('forced', 'first', 'passed') AS promoted, reason FROM decided""",
)
def tolerant_promotion(spark, sf_dir):
    """A candidate may be slightly worse than what is live."""
    out = pm.promotion_history(promotion_requests(spark, sf_dir), _TOLERANCE)
    return out.fillna(-1, ["incumbent_version"])


@query(
    "previous_version",
    f"""WITH {_REQUESTS}, {_HISTORY} SELECT name, max_by(version, seq) AS live_version,
  coalesce((arg_max({{'v': incumbent_version}}, seq)).v, -1) AS previous_version FROM decided WHERE reason IN ('forced', 'first', 'passed') GROUP BY name""",
)
def previous_version(spark, sf_dir):
    out = pm.previous_version(pm.promotion_history(promotion_requests(spark, sf_dir)))
    return out.fillna(-1, ["previous_version"])


@query("latest_version", f"WITH {_REQUESTS} SELECT name, max(version) AS version FROM requests GROUP BY name")
def latest_version(spark, sf_dir):
    return pm.latest_version(promotion_requests(spark, sf_dir))


@query(
    "best_run",
    f"""WITH {_REQUESTS} SELECT name, seq, version, roc_auc, forced FROM (SELECT *, row_number() OVER
  (PARTITION BY name ORDER BY roc_auc DESC NULLS LAST, seq) AS place FROM requests) WHERE place = 1""",
)
def best_run(spark, sf_dir):
    return pm.best_run(promotion_requests(spark, sf_dir), order="seq")


# -- states that merge ---------------------------------------------------------------------------

_PARITY = """parity AS (SELECT *, CAST(unit_id % 2 AS INT) AS half FROM scored),
halves AS (SELECT half, score, n, pos, sum(n) OVER d AS cum_n, sum(pos) OVER d AS cum_pos, sum(n) OVER (PARTITION BY half) AS all_n,
  sum(pos) OVER (PARTITION BY half) AS all_pos FROM (SELECT half, score, count(*) AS n, sum(failure_within_h) AS pos FROM parity GROUP BY half, score)
  WINDOW d AS (PARTITION BY half ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _grades(spark, sf_dir):
    """Ten batches, one of them twice, folded into a base after the sixth."""
    rows = scored(spark, sf_dir).withColumn("half", (F.col("unit_id") % 2).cast("int"))
    store = GradeStore(spark, new_path(spark, "grades"), ["half"])
    for i in (0, 1, 2, 3, 4, 3, 5, 6, 7, 8, 9):
        store.add(str(i), rows.where(F.col("unit_id") % 10 == i), "score", "failure_within_h")
        if i == 5:
            store.compact()
    return store


@query(
    "standing_grades",
    on_readings(
        f"""SELECT half, n_rows, n_positive, {rd('roc_auc')} AS roc_auc, {rd('average_precision')} AS average_precision, alarm_cut
FROM ({_auc_sql('parity', 'failure_within_h', 'half')}) JOIN (SELECT half,
  sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(all_pos) AS average_precision,
  min(score) FILTER (cum_n <= greatest(1, round_even(all_n * 0.02e0, 0))) AS alarm_cut FROM halves GROUP BY half) USING (half)""",
        _PARITY,
    ),
)
def standing_grades(spark, sf_dir):
    store = _grades(spark, sf_dir)
    out = store.roc_auc().join(store.average_precision(), "half").join(store.alarm_cuts(), "half")
    return rounded_columns(out, ["roc_auc", "average_precision"])


@query(
    "standing_calibration",
    on_readings(
        f"""SELECT half, bin, n, {rd('s / n')} AS mean_predicted, {rd('p / CAST(n AS DOUBLE)')} AS observed_rate FROM (SELECT half,
  CAST({' + '.join(f"CAST(score >= {i * (1.0 / 10)!r}e0 AS INT)" for i in range(1, 10))} AS INT) AS bin, count(*) AS n, sum(score) AS s,
  sum(failure_within_h) AS p FROM parity GROUP BY 1, 2)""",
        _PARITY,
    ),
)
def standing_calibration(spark, sf_dir):
    return rounded_columns(_grades(spark, sf_dir).calibration(), ["mean_predicted", "observed_rate"])


_LATER = 1_000_000  # slices of the shifted readings lie beyond all others


@query(
    "sketch_drift",
    on_readings(
        f"SELECT signal, n_ref, n_cur, {rd('ref_std')} AS ref_std, wasserstein_norm >= 0.1e0 AS drifted FROM lam",
        _CDF,
    ),
)
def sketch_drift(spark, sf_dir):
    """Weekly sketches of all readings, in two batches, against those of the shifted ones before a failure."""
    before, shifted = _drift_frames(spark, sf_dir)
    week = F.floor(F.col("timestamp_h") / 168)
    store = SketchStore(spark, new_path(spark, "sketches"), week)
    store.add("even", before.where("unit_id % 2 = 0"))
    store.add("odd", before.where("unit_id % 2 = 1"))
    store.add("shifted", shifted.withColumn("timestamp_h", F.col("timestamp_h") + 168.0 * _LATER))
    out = store.drift((0, _LATER), (_LATER, 2 * _LATER))
    return rounded_columns(out.select("signal", "n_ref", "n_cur", "ref_std", "drifted"), ["ref_std"])

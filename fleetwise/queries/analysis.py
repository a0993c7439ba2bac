"""Queries on aggregates, windows, ranking metrics, roll-ups, splits and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwise.operators import aggregates as agg
from fleetwise.operators import drift as dr
from fleetwise.operators import grading as gr
from fleetwise.operators import intervals as iv
from fleetwise.operators import projection as pj
from fleetwise.operators import rollup as ru
from fleetwise.operators import splits as sp
from fleetwise.operators import windows as wn
from fleetwise.queries.base import (
    UNIT_TIME,
    each,
    on_readings,
    query,
    rd,
    rounded,
    rounded_columns,
    scored,
    union,
)
from fleetwise.queries.tables import _BESIDE, _EVENTS, SHIFTS, unit_classes
from fleetwise.sources.stand_in import readings
from fleetwise.spec import DEFAULT, FAILURE_MODES, FAMILIES, SIGNALS

KEY = DEFAULT.key

# -- aggregates ----------------------------------------------------------------------------------


@query(
    "signal_medians",
    on_readings(union(f"SELECT '$' AS signal, {rd('quantile_cont($, 0.5)', 9)} AS median FROM readings")),
)
def signal_medians(spark, sf_dir):
    found = agg.signal_medians(readings(spark, sf_dir))
    rows = spark.createDataFrame(list(found.items()), "signal string, median double")
    return rounded_columns(rows, ["median"], 9)


@query(
    "signal_moments",
    on_readings(
        union(
            f"SELECT '$' AS signal, count($) AS n, {rd('avg($)')} AS mean, "
            f"{rd('stddev_samp($)')} AS std_samp, {rd('stddev_pop($)')} AS std_pop FROM readings"
        )
    ),
)
def signal_moments(spark, sf_dir):
    table = agg.moments_table(readings(spark, sf_dir))
    return rounded_columns(table, ["mean", "std_samp", "std_pop"])


@query(
    "minmax01",
    on_readings(
        "SELECT unit_id, t_index, coalesce((egt_c - lo) / (hi - lo), 0e0) AS scaled FROM readings, "
        "(SELECT min(egt_c) AS lo, max(egt_c) AS hi FROM readings)"
    ),
)
def minmax01(spark, sf_dir):
    return agg.minmax01(readings(spark, sf_dir), "egt_c", "scaled").select(*KEY, "scaled")


_FLAGS = f"""stepped AS (SELECT *, {each(f"CASE WHEN $ = lag($) OVER ({UNIT_TIME}) THEN 1 ELSE 0 END AS $__repeat")},
{each(f"sign($ - lag($) OVER ({UNIT_TIME})) AS $__sign")} FROM scored),
islands AS (SELECT *, {each(f"sum(1 - $__repeat) OVER ({UNIT_TIME}) AS $__island")},
{each(f"CASE WHEN count($__sign) OVER ({UNIT_TIME} ROWS 11 PRECEDING) = 12 AND abs(avg($__sign) OVER ({UNIT_TIME} ROWS 11 PRECEDING)) >= 0.9e0 THEN 1 ELSE 0 END AS $__monotone")}
FROM stepped),
flags AS (SELECT *, {each("CASE WHEN count(*) OVER (PARTITION BY unit_id, $__island) >= 5 THEN 1 ELSE 0 END AS $__stuck")} FROM islands)"""
_RATES = "rates AS (SELECT {} FROM flags)".format(
    each(
        "avg(CASE WHEN $ IS NOT NULL THEN $__repeat END) AS $__rr, avg($__monotone) AS $__mr, count($) AS $__n"
    )
)
_TEMPORAL = """temporal AS (SELECT f.*, CAST(greatest({}, {}) AS DOUBLE) AS temporal FROM flags f, rates)""".format(
    each("CASE WHEN $__n > 0 AND $__rr < 0.01e0 THEN $__stuck ELSE 0 END"),
    each("CASE WHEN $__n > 0 AND $__mr < 0.15e0 THEN $__monotone ELSE 0 END"),
)


def _rate_query(column: str, short: str):
    return on_readings(
        union(f"SELECT '$' AS signal, {rd(f'$__{short}', 9)} AS {column} FROM rates"), _FLAGS, _RATES
    )


@query("repeat_rate", _rate_query("repeat_rate", "rr"))
def repeat_rate(spark, sf_dir):
    rates = agg.shape_rates(readings(spark, sf_dir))
    return rates.select("signal", rounded("repeat_rate", 9).alias("repeat_rate"))


@query("monotone_rate", _rate_query("monotone_rate", "mr"))
def monotone_rate(spark, sf_dir):
    rates = agg.shape_rates(readings(spark, sf_dir))
    return rates.select("signal", rounded("monotone_rate", 9).alias("monotone_rate"))


@query(
    "suspect_rate",
    on_readings(
        f"SELECT count(*) AS n_rows, {rd('avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END)')} AS suspect_rate FROM scored"
    ),
)
def suspect_rate(spark, sf_dir):
    return rounded_columns(agg.suspect_rate(scored(spark, sf_dir), "score"), ["suspect_rate"])


@query(
    "data_quality_check",
    on_readings(
        f"""SELECT c.n AS n_rows, {rd('c.rate')} AS suspect_rate, {rd('b.rate')} AS baseline_rate,
  3e0 AS spike_factor, c.rate > 3e0 * b.rate AS tripped
FROM (SELECT count(*) AS n, avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS rate FROM scored WHERE failure_within_h = 1) c,
 (SELECT avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS rate FROM scored WHERE failure_within_h = 0) b"""
    ),
)
def data_quality_check(spark, sf_dir):
    df = scored(spark, sf_dir)
    healthy, failing = df.filter("failure_within_h = 0"), df.filter("failure_within_h = 1")
    baseline = agg.suspect_rate(healthy, "score").first()["suspect_rate"]
    out = agg.data_quality_check(failing, "score", baseline)
    return rounded_columns(out, ["suspect_rate", "baseline_rate"])


# -- windows -------------------------------------------------------------------------------------

_FRAME = f"OVER ({UNIT_TIME} ROWS 23 PRECEDING)"
_MEAN = f"CASE WHEN count($) {_FRAME} >= 2 THEN " + rd(f"avg($) {_FRAME}", 9) + " END AS $__mean"
_STD = f"CASE WHEN count($) {_FRAME} >= 2 THEN " + rd(f"stddev_samp($) {_FRAME}", 4) + " END AS $__std"
_SLOPE = rd(f"avg($__step) {_FRAME}", 9) + " AS $__slope"
_DELTA = rd(f"$ - lag($, 23) OVER ({UNIT_TIME})", 9) + " AS $__delta"
_STEPS = f"steps_of AS (SELECT *, {each(f'$ - lag($) OVER ({UNIT_TIME}) AS $__step')} FROM readings)"
_DIGITS = {"mean": 9, "std": 4, "slope": 9, "delta": 9}


def _temporal(spark, sf_dir, stats, signals=True):
    out = wn.temporal_features(readings(spark, sf_dir), stats=stats)
    made = {f"{s}__{k}": _DIGITS[k] for s in SIGNALS for k in stats}
    keep = SIGNALS if signals else ()
    return out.select(*KEY, *keep, *[rounded(c, d).alias(c) for c, d in made.items()])


def _one_stat(name, stat, sql):
    @query(name, on_readings(f"SELECT unit_id, t_index, {each(sql)} FROM steps_of", _STEPS))
    def run(spark, sf_dir):
        return _temporal(spark, sf_dir, [stat], signals=False)

    return run


roll_mean = _one_stat("roll_mean", "mean", _MEAN)
roll_std = _one_stat("roll_std", "std", _STD)
roll_slope = _one_stat("roll_slope", "slope", _SLOPE)
roll_delta = _one_stat("roll_delta", "delta", _DELTA)


@query(
    "temporal_features",
    on_readings(
        f"SELECT unit_id, t_index, {', '.join(SIGNALS)}, {each(_MEAN)}, {each(_STD)}, {each(_SLOPE)}, {each(_DELTA)} FROM steps_of",
        _STEPS,
    ),
)
def temporal_features(spark, sf_dir):
    return _temporal(spark, sf_dir, wn.STATS)


def _flag_query(kind):
    return on_readings(
        "SELECT unit_id, t_index, " + each(f"$__{kind}") + " FROM flags", _FLAGS
    )


@query("monotone_window", _flag_query("monotone"))
def monotone_window(spark, sf_dir):
    return wn.shape_flags(readings(spark, sf_dir), [], SIGNALS)


@query("stuck_blocks", _flag_query("stuck"))
def stuck_blocks(spark, sf_dir):
    out = wn.shape_flags(readings(spark, sf_dir), SIGNALS, [])
    return out.select(*KEY, *[f"{s}__stuck" for s in SIGNALS])


@query(
    "equal_run",
    on_readings(
        "SELECT unit_id, t_index, "
        + each(
            "CAST(row_number() OVER (PARTITION BY unit_id, $__island ORDER BY t_index) - 1 AS INT) AS $__run"
        )
        + " FROM islands",
        _FLAGS,
    ),
)
def equal_run(spark, sf_dir):
    return wn.equal_run(readings(spark, sf_dir))


@query(
    "temporal_detector",
    on_readings("SELECT unit_id, t_index, temporal FROM temporal", _FLAGS, _RATES, _TEMPORAL),
)
def temporal_detector(spark, sf_dir):
    from fleetwise.detectors.temporal import TemporalDetector

    df = readings(spark, sf_dir).select(*KEY, *SIGNALS)
    return TemporalDetector().fit(df).transform(df).select(*KEY, "temporal")


@query(
    "window_tensor",
    on_readings(
        "SELECT unit_id, t_index, "
        + each(
            rd(
                f"sum(($__z) * (t_index + 1)) {_FRAME} - (t_index - 23) * sum($__z) {_FRAME}", 4
            )
            + " AS $__values"
        )
        + ", "
        + each(f"CAST(count($) {_FRAME} AS INT) AS $__present")
        + " FROM centred",
        "fitted AS (SELECT " + each("avg($) AS $_m, stddev_pop($) AS $_s") + " FROM readings)",
        "centred AS (SELECT r.*, "
        + each("coalesce(($ - $_m) / coalesce(nullif($_s, 0), 1e0), 0e0) AS $__z")
        + " FROM readings r, fitted)",
    ),
)
def window_tensor(spark, sf_dir):
    """The tensor, shown as place-weighted sums: place 1 is the oldest cell of 24."""
    df = readings(spark, sf_dir)
    fitted = agg.signal_moments(df, sample=False)
    tensor = wn.window_tensor(df, fitted.centre, fitted.scale)
    add = lambda a, x: a + x
    return tensor.select(
        *KEY,
        *[
            rounded(
                F.aggregate(
                    F.transform(f"{s}__values", lambda x, i: x * (i + 1)), F.lit(0.0), add
                ),
                4,
            ).alias(f"{s}__values")
            for s in SIGNALS
        ],
        *[
            F.aggregate(f"{s}__present", F.lit(0.0), add).cast("int").alias(f"{s}__present")
            for s in SIGNALS
        ],
    )


@query(
    "time_to_failure",
    on_readings(
        """SELECT unit_id, t_index, CASE WHEN failure_within_h = 1 THEN event_time - timestamp_h
  ELSE CAST('Infinity' AS DOUBLE) END AS time_to_failure_h FROM beside""",
        _BESIDE,
    ),
)
def time_to_failure(spark, sf_dir):
    return wn.time_to_failure(readings(spark, sf_dir)).select(*KEY, "time_to_failure_h")


_SHORT = f"sustained AS (SELECT *, avg(score) OVER ({UNIT_TIME} ROWS 11 PRECEDING) AS sustained FROM scored)"


@query(
    "sustained_risk",
    on_readings(f"SELECT unit_id, t_index, {rd('sustained', 9)} AS sustained FROM sustained", _SHORT),
)
def sustained_risk(spark, sf_dir):
    out = ru.sustained_risk(scored(spark, sf_dir).select(*KEY, "score"), "score")
    return out.select(*KEY, rounded("sustained", 9).alias("sustained"))


_ROLLUP = """rolled AS (SELECT unit_id, count(*) AS n_rows, max(sustained) AS risk, max(score) AS peak,
  avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS high_risk_share, max(sustained) >= 0.7e0 AS flagged
  FROM sustained GROUP BY unit_id)"""
ROLLUP_SQL = f"SELECT unit_id, n_rows, {rd('risk')} AS risk, peak, {rd('high_risk_share')} AS high_risk_share, flagged"


def rolled_up(spark, sf_dir):
    return rounded_columns(
        ru.unit_rollup(scored(spark, sf_dir), "score"), ["risk", "high_risk_share"]
    )


@query("unit_rollup", on_readings(ROLLUP_SQL + " FROM rolled", _SHORT, _ROLLUP))
def unit_rollup(spark, sf_dir):
    return rolled_up(spark, sf_dir)


@query(
    "unit_rank",
    on_readings(
        f"SELECT unit_id, {rd('risk')} AS risk, rank() OVER (ORDER BY {rd('risk')} DESC) AS rank FROM rolled",
        _SHORT,
        _ROLLUP,
    ),
)
def unit_rank(spark, sf_dir):
    return wn.unit_rank(rolled_up(spark, sf_dir), "risk").select("unit_id", "risk", "rank")


@query(
    "fleet_report",
    on_readings(
        "SELECT count(*) AS n_units, count(*) FILTER (flagged) AS n_flagged, CAST(sum(n_rows) AS BIGINT) AS n_rows_scored FROM rolled",
        _SHORT,
        _ROLLUP,
    ),
)
def fleet_report(spark, sf_dir):
    return ru.fleet_report(ru.unit_rollup(scored(spark, sf_dir), "score"))


# -- ranking metrics -----------------------------------------------------------------------------


def _auc_sql(source, label, by="", score="score", pos=None):
    """Mann-Whitney on grouped scores."""
    keys, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {keys}CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(pos) AS BIGINT) AS n_positive,
  sum(pos * (below + neg / 2e0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS roc_auc
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {keys}{score} AS s, count(*) AS n, sum({label}) AS pos, count(*) - sum({label}) AS neg FROM {source} GROUP BY {keys}{score}))
{'GROUP BY ' + by if by else ''}"""


_OUTLIER = "CASE WHEN is_outlier THEN 1 ELSE 0 END"


@query(
    "roc_auc",
    on_readings(
        f"SELECT n_rows, n_positive, {rd('roc_auc')} AS roc_auc FROM ({_auc_sql('scored', 'failure_within_h')})"
    ),
)
def roc_auc(spark, sf_dir):
    out = gr.roc_auc(scored(spark, sf_dir), "score", "failure_within_h")
    return rounded_columns(out, ["roc_auc"])


_SWEEP = """sweep AS (SELECT score AS threshold, pos, sum(pos) OVER d AS cum_pos, sum(n) OVER d AS cum_n, sum(pos) OVER () AS all_pos
  FROM (SELECT score, count(*) AS n, sum(failure_within_h) AS pos FROM scored GROUP BY score)
  WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "average_precision",
    on_readings(
        f"SELECT {rd('sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(all_pos)')} AS average_precision FROM sweep",
        _SWEEP,
    ),
)
def average_precision(spark, sf_dir):
    out = gr.average_precision(scored(spark, sf_dir), "score", "failure_within_h")
    return rounded_columns(out, ["average_precision"])


@query(
    "threshold_sweep",
    on_readings(
        f"SELECT threshold, {rd('cum_pos / CAST(cum_n AS DOUBLE)', 9)} AS precision, {rd('cum_pos / CAST(all_pos AS DOUBLE)', 9)} AS recall FROM sweep",
        _SWEEP,
    ),
)
def threshold_sweep(spark, sf_dir):
    out = gr.threshold_sweep(scored(spark, sf_dir), "score", "failure_within_h")
    return rounded_columns(out, ["precision", "recall"], 9)


_ALARMED = """alarmed AS (SELECT s.*, r.at_or_above <= greatest(1, round_even(0.02e0 * r.total, 0)) AS alarm FROM scored s
  JOIN (SELECT score, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS at_or_above, sum(n) OVER () AS total
  FROM (SELECT score, count(*) AS n FROM scored GROUP BY score)) r USING (score))"""


@query(
    "alarm_set", on_readings("SELECT unit_id, t_index, score FROM alarmed WHERE alarm", _ALARMED)
)
def alarm_set(spark, sf_dir):
    return gr.alarm_set(scored(spark, sf_dir), "score").select(*KEY, "score")


@query(
    "family_recall",
    on_readings(
        "\nUNION ALL\n".join(
            f"""SELECT '{f}' AS family, count(*) FILTER (anomaly_type = '{f}') AS n_rows,
  count(*) FILTER (anomaly_type = '{f}' AND alarm) AS n_alarmed,
  {rd(f"count(*) FILTER (anomaly_type = '{f}' AND alarm) / CAST(nullif(count(*) FILTER (anomaly_type = '{f}'), 0) AS DOUBLE)")} AS recall FROM alarmed"""
            for f in FAMILIES
        ),
        _ALARMED,
    ),
)
def family_recall(spark, sf_dir):
    return rounded_columns(gr.family_recall(scored(spark, sf_dir), "score"), ["recall"])


_DETECTORS = f"""outside AS (SELECT *, ({" + ".join(f"CASE WHEN NOT ({s} BETWEEN {lo!r}e0 AND {hi!r}e0) THEN 1 ELSE 0 END" for s, (lo, hi) in pj.SIGNAL_BOUNDS.items())}) / 9e0 AS out_of_range FROM temporal),
long AS (SELECT 'linear' AS detector, score AS s, is_outlier, anomaly_type FROM outside
  UNION ALL SELECT 'temporal', temporal, is_outlier, anomaly_type FROM outside
  UNION ALL SELECT 'range', out_of_range, is_outlier, anomaly_type FROM outside),
counted AS (SELECT detector, s, count(*) AS n, sum({_OUTLIER}) AS pos, {", ".join(f"count(*) FILTER (anomaly_type = '{f}') AS fam_{f}" for f in FAMILIES)} FROM long GROUP BY detector, s),
run AS (SELECT *, sum(n) OVER d AS cum_n, sum(pos) OVER d AS cum_pos, sum(n) OVER (PARTITION BY detector) AS all_n, sum(pos) OVER (PARTITION BY detector) AS all_pos
  FROM counted WINDOW d AS (PARTITION BY detector ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
grades AS (SELECT detector, CAST(sum(n) AS BIGINT) AS n_rows,
  sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2e0)) / (max(all_pos) * CAST(max(all_n) - max(all_pos) AS DOUBLE)) AS roc_auc,
  sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(all_pos) AS average_precision,
  {", ".join(f"coalesce(sum(fam_{f}) FILTER (cum_n <= greatest(1, round_even(0.02e0 * all_n, 0))), 0) / CAST(nullif(sum(fam_{f}), 0) AS DOUBLE) AS recall_{f}" for f in FAMILIES)}
  FROM run GROUP BY detector)"""
_RECALLS = [f"recall_{f}" for f in FAMILIES]


def _long_scores(spark, sf_dir):
    from fleetwise.detectors.temporal import TemporalDetector

    df = scored(spark, sf_dir)
    wide = TemporalDetector().fit(df).transform(df)
    wide = wide.select(
        "is_outlier",
        "anomaly_type",
        F.col("score").alias("linear"),
        "temporal",
        (pj.outside_range() / F.lit(9.0)).alias("range"),
    )
    return wide.unpivot(["is_outlier", "anomaly_type"], ["linear", "temporal", "range"], "detector", "score")


@query(
    "score_ladder",
    on_readings(
        f"SELECT detector, n_rows, {rd('roc_auc')} AS roc_auc, {rd('average_precision')} AS average_precision, "
        + ", ".join(f"{rd(c)} AS {c}" for c in _RECALLS)
        + " FROM grades",
        _FLAGS,
        _RATES,
        _TEMPORAL,
        _DETECTORS,
    ),
)
def score_ladder(spark, sf_dir):
    grades = gr.ladder_grades(_long_scores(spark, sf_dir))
    return rounded_columns(grades, ["roc_auc", "average_precision", *_RECALLS])


_SUBTLE = "(recall_joint_outlier + recall_sensor_stuck + recall_sensor_drift) / 3e0"


@query(
    "ladder_verdict",
    on_readings(
        f"""SELECT {rd('a')} AS adaptive_subtle_recall, {rd('b')} AS best_other_subtle_recall, a > b AS earns_place FROM (
  SELECT max(CASE WHEN detector = 'temporal' THEN {_SUBTLE} END) AS a, max(CASE WHEN detector <> 'temporal' THEN {_SUBTLE} END) AS b FROM grades)""",
        _FLAGS,
        _RATES,
        _TEMPORAL,
        _DETECTORS,
    ),
)
def ladder_verdict(spark, sf_dir):
    out = gr.adaptive_verdict(gr.ladder_grades(_long_scores(spark, sf_dir)), "temporal")
    return rounded_columns(out, ["adaptive_subtle_recall", "best_other_subtle_recall"])


@query(
    "calibration",
    on_readings(
        f"""SELECT CAST({" + ".join(f"CASE WHEN score >= {i * 0.1!r}e0 THEN 1 ELSE 0 END" for i in range(1, 10))} AS INT) AS bin,
  {rd('avg(score)')} AS mean_predicted, {rd('avg(failure_within_h)')} AS observed_rate, count(*) AS n FROM scored GROUP BY 1"""
    ),
)
def calibration(spark, sf_dir):
    out = gr.calibration(scored(spark, sf_dir), "score", "failure_within_h")
    return rounded_columns(out, ["mean_predicted", "observed_rate"])


@query(
    "batch_summary",
    on_readings(
        """SELECT count(*) AS n_rows, count(*) FILTER (score >= 0.5e0) AS n_high_risk,
  round(100e0 * count(*) FILTER (score >= 0.5e0) / count(*), 6) AS pct_high_risk,
  CAST(b.bin AS INT) AS bin, b.bin / 10e0 AS bin_low, (b.bin + 1) / 10e0 AS bin_high,
  count(*) FILTER (least(CAST(floor(score * 10e0) AS INT), 9) = b.bin) AS n
FROM scored, range(10) AS b(bin) GROUP BY b.bin"""
    ),
)
def batch_summary(spark, sf_dir):
    return rounded_columns(gr.batch_summary(scored(spark, sf_dir), "score"), ["pct_high_risk"])


_BANDS = gr.horizon_bands()


def _sliced(slices, source):
    """One AUC per slice: its positives against all negatives."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS slice, n_rows, n_positive, {rd('roc_auc')} AS roc_auc FROM ("
        + _auc_sql(f"(SELECT * FROM {source} WHERE failure_within_h = 0 OR ({cond}))", "failure_within_h")
        + ")"
        for name, cond in slices.items()
    )


_TIMED = "timed AS (SELECT s.*, event_time - timestamp_h AS ttf FROM scored s LEFT JOIN events_at USING (unit_id))"


_HORIZON_SQL = _sliced(
    {
        k: f"ttf >= {lo!r}e0" + (f" AND ttf < {hi!r}e0" if hi != float("inf") else "")
        for k, (lo, hi) in _BANDS.items()
    },
    "timed",
)


@query(
    "auc_by_horizon",
    on_readings(
        _HORIZON_SQL,
        _EVENTS,
        _TIMED,
    ),
)
def auc_by_horizon(spark, sf_dir):
    df = wn.time_to_failure(scored(spark, sf_dir))
    return rounded_columns(gr.auc_by_horizon(df, "score"), ["roc_auc"])


# The draws are checked in tests/test_intervals.py; the SQL states the AUC and that the interval holds it.
@query(
    "auc_intervals",
    on_readings(
        f"""SELECT slice, n_positive, roc_auc, CAST(200 AS BIGINT) AS n_replicates, true AS holds FROM ({_HORIZON_SQL})""",
        _EVENTS,
        _TIMED,
    ),
)
def auc_intervals(spark, sf_dir):
    df = wn.time_to_failure(scored(spark, sf_dir))
    out = iv.auc_intervals_by_horizon(df, "score")
    inside = (F.col("low") <= F.col("roc_auc")) & (F.col("roc_auc") <= F.col("high")) & (F.col("low") < F.col("high"))
    out = out.select("slice", "n_positive", "roc_auc", "n_replicates", inside.alias("holds"))
    return rounded_columns(out, ["roc_auc"])


@query(
    "auc_by_mode",
    on_readings(_sliced({m: f"failure_mode = '{m}'" for m in sorted(FAILURE_MODES)}, "scored")),
)
def auc_by_mode(spark, sf_dir):
    return rounded_columns(gr.auc_by_mode(scored(spark, sf_dir), "score"), ["roc_auc"])


_RULE_SQL = {
    "max": "max(score)",
    "share_50": "avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END)",
    "share_80": "avg(CASE WHEN score >= 0.8e0 THEN 1e0 ELSE 0e0 END)",
    "p95": "quantile_cont(score, 0.95)",
    "mean_12": "max(short_mean)",
    "mean_72": "max(long_mean)",
}
_RULES = f"""meant AS (SELECT *, avg(score) OVER ({UNIT_TIME} ROWS 11 PRECEDING) AS short_mean,
  avg(score) OVER ({UNIT_TIME} ROWS 71 PRECEDING) AS long_mean FROM scored),
ruled AS ({" UNION ALL ".join(f"SELECT unit_id, '{k}' AS rule, round({v}, 9) AS value, max(failure_within_h) AS fails FROM meant GROUP BY unit_id" for k, v in _RULE_SQL.items())})"""


@query(
    "compare_rollups",
    on_readings(
        f"""SELECT a.rule, a.n_rows AS n_units, a.n_positive AS n_failing, {rd('a.roc_auc')} AS roc_auc,
  {rd('f.recall')} AS recall, {rd('f.precision')} AS precision, {rd('f.flagged_share')} AS flagged_share
FROM ({_auc_sql('ruled', 'fails', 'rule', 'value')}) a JOIN (SELECT rule,
  count(*) FILTER (value >= 0.7e0 AND fails = 1) / CAST(nullif(sum(fails), 0) AS DOUBLE) AS recall,
  count(*) FILTER (value >= 0.7e0 AND fails = 1) / CAST(nullif(count(*) FILTER (value >= 0.7e0), 0) AS DOUBLE) AS precision,
  avg(CASE WHEN value >= 0.7e0 THEN 1e0 ELSE 0e0 END) AS flagged_share FROM ruled GROUP BY rule) f USING (rule)""",
        _RULES,
    ),
)
def compare_rollups(spark, sf_dir):
    out = ru.compare_rollups(scored(spark, sf_dir), "score")
    return rounded_columns(out, ["roc_auc", "recall", "precision", "flagged_share"])


# -- splits --------------------------------------------------------------------------------------

_SPLIT = """sides AS (SELECT unit_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(unit_id AS VARCHAR)))
  <= ceil(0.25e0 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT unit_id FROM readings)),
halves AS (SELECT * FROM scored JOIN sides USING (unit_id))"""


@query("grouped_split", on_readings("SELECT unit_id, t_index, split FROM halves", _SPLIT))
def grouped_split(spark, sf_dir):
    return sp.grouped_split(readings(spark, sf_dir).select(*KEY)).select(*KEY, "split")


def _folds(source):
    return f"""folds AS (SELECT unit_id, n_rows, CAST(CASE WHEN place % 10 < 5 THEN place % 10 ELSE 9 - place % 10 END AS INT) AS fold
  FROM (SELECT unit_id, n_rows, row_number() OVER (ORDER BY n_rows DESC, unit_id) - 1 AS place
  FROM (SELECT unit_id, count(*) AS n_rows FROM {source} GROUP BY unit_id)))"""


@query("grouped_folds", on_readings("SELECT unit_id, n_rows, fold FROM folds", _folds("readings")))
def grouped_folds(spark, sf_dir):
    return sp.fold_units(readings(spark, sf_dir))


@query(
    "split_profile",
    on_readings(
        """SELECT split, count(*) AS n_rows, count(DISTINCT unit_id) AS n_units, CAST(sum(failure_within_h) AS BIGINT) AS n_positive,
  CAST(count(DISTINCT failure_within_h) AS INT) AS n_classes FROM halves GROUP BY split""",
        _SPLIT,
    ),
)
def split_profile(spark, sf_dir):
    return sp.split_profile(sp.grouped_split(readings(spark, sf_dir)))


@query(
    "split_overlap",
    on_readings(
        "SELECT unit_id FROM halves WHERE split = 'train' INTERSECT SELECT unit_id FROM halves WHERE split = 'test'",
        _SPLIT,
    ),
)
def split_overlap(spark, sf_dir):
    return sp.split_overlap(sp.grouped_split(readings(spark, sf_dir).select(*KEY)))


@query(
    "column_difference",
    on_readings(
        "SELECT 'no_such_signal' AS missing_column, count(*) AS n_rows FROM readings"
    ),
)
def column_difference(spark, sf_dir):
    df = readings(spark, sf_dir)
    absent = pj.missing_columns(df, ["no_such_signal", *SIGNALS])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in absent])).alias("missing_column"), "n_rows"
    )


@query(
    "per_unit_sort",
    on_readings("SELECT unit_id, t_index, failure_within_h FROM readings ORDER BY unit_id, t_index"),
)
def per_unit_sort(spark, sf_dir):
    df = readings(spark, sf_dir).select(*KEY, "failure_within_h")
    return df.repartitionByRange(*KEY).sortWithinPartitions(*KEY)


_MODES = "modes AS (SELECT unit_id, coalesce(max(CASE WHEN failure_within_h = 1 THEN failure_mode END), '') AS event_mode FROM readings GROUP BY unit_id)"


@query("unit_event_mode", on_readings("SELECT unit_id, event_mode FROM modes", _MODES))
def unit_event_mode(spark, sf_dir):
    return sp.unit_event_mode(readings(spark, sf_dir))


@query(
    "mode_coverage",
    on_readings(
        "\nUNION ALL\n".join(
            f"SELECT '{m}' AS mode, count(*) FILTER (failure_within_h = 1 AND failure_mode = '{m}') AS n_positive, "
            f"count(*) FILTER (failure_within_h = 1 AND failure_mode = '{m}') > 0 AS covered FROM readings"
            for m in FAILURE_MODES
        )
    ),
)
def mode_coverage(spark, sf_dir):
    return sp.mode_coverage(readings(spark, sf_dir))


@query(
    "stratified_units",
    on_readings(
        """SELECT unit_id, event_mode, unit_class, CAST(turn AS INT) AS turn, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY event_mode ORDER BY turn, unit_class) AS place FROM (
    SELECT unit_id, event_mode, s_nationkey AS unit_class, row_number() OVER (PARTITION BY event_mode, s_nationkey
      ORDER BY md5('42:' || CAST(unit_id AS VARCHAR))) AS turn FROM modes LEFT JOIN supplier ON s_suppkey = unit_id))
WHERE place <= CASE WHEN event_mode = '' THEN 10 ELSE 8 END""",
        _MODES,
    ),
)
def stratified_units(spark, sf_dir):
    modes = sp.unit_event_mode(readings(spark, sf_dir))
    return sp.stratified_units(modes, unit_classes(spark, sf_dir), "unit_class", strict=False)


_CV = _folds("(SELECT * FROM halves WHERE split = 'train')")


@query(
    "audit_fit",
    on_readings(
        f"""SELECT {rd('tr')} AS train_auc, {rd('cv')} AS cv_auc, {rd('te')} AS test_auc, {rd('tr - cv')} AS overfit_gap,
  tr - cv > 0.15e0 AS overfit_tripped, te > 0.505e0 AS beats_majority, tr - cv > 0.15e0 OR NOT te > 0.505e0 AS tripped
FROM (SELECT max(CASE WHEN split = 'train' THEN roc_auc END) AS tr, max(CASE WHEN split = 'test' THEN roc_auc END) AS te
  FROM ({_auc_sql('halves', 'failure_within_h', 'split')})),
 (SELECT avg(roc_auc) AS cv FROM ({_auc_sql('(SELECT h.*, fold FROM halves h JOIN folds USING (unit_id))', 'failure_within_h', 'fold')}))""",
        _SPLIT,
        _CV,
    ),
)
def audit_fit(spark, sf_dir):
    split = sp.grouped_split(scored(spark, sf_dir).select(*KEY, "score", "failure_within_h"))
    sides = gr.roc_auc(split, "score", "failure_within_h", ["split"])
    folds = sp.grouped_folds(split.filter("split = 'train'"))
    cv = gr.roc_auc(folds, "score", "failure_within_h", ["fold"]).agg(F.avg("roc_auc").alias("cv_auc"))
    at = {r["split"]: r["roc_auc"] for r in sides.collect()}
    aucs = cv.select(
        F.lit(at.get("train")).cast("double").alias("train_auc"),
        "cv_auc",
        F.lit(at.get("test")).cast("double").alias("test_auc"),
    )
    out = gr.audit_fit(aucs)
    return rounded_columns(out, ["train_auc", "cv_auc", "test_auc", "overfit_gap"])


@query(
    "impute_center",
    on_readings(
        "SELECT unit_id, t_index, " + each("coalesce($, $_m) AS $") + " FROM readings, middle",
        "middle AS (SELECT " + each("quantile_cont($, 0.5) AS $_m") + " FROM readings)",
    ),
)
def impute_center(spark, sf_dir):
    df = readings(spark, sf_dir).select(*KEY, *SIGNALS)
    return agg.impute(df, agg.signal_medians(df))


# -- drift ---------------------------------------------------------------------------------------

_SHIFTED = ", ".join(f"{s} + 25e0 AS {s}" if s in SHIFTS else s for s in SIGNALS)
_CDF = f"""shifted AS (SELECT {_SHIFTED} FROM readings WHERE failure_within_h = 1),
counts AS (SELECT signal, value, sum(r) AS n_ref, sum(c) AS n_cur FROM (
  {union("SELECT '$' AS signal, $ AS value, 1 AS r, 0 AS c FROM readings WHERE $ IS NOT NULL")} UNION ALL
  {union("SELECT '$' AS signal, $ AS value, 0 AS r, 1 AS c FROM shifted WHERE $ IS NOT NULL")}) GROUP BY signal, value),
cdf AS (SELECT *, sum(n_ref) OVER o / CAST(sum(n_ref) OVER (PARTITION BY signal) AS DOUBLE) AS f,
  sum(n_cur) OVER o / CAST(sum(n_cur) OVER (PARTITION BY signal) AS DOUBLE) AS g,
  lead(value) OVER (PARTITION BY signal ORDER BY value) AS nxt FROM counts
  WINDOW o AS (PARTITION BY signal ORDER BY value ROWS UNBOUNDED PRECEDING)),
dist AS (SELECT signal, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cur) AS BIGINT) AS n_cur, max(abs(f - g)) AS ks,
  sum(abs(f - g) * coalesce(nxt - value, 0e0)) AS wasserstein FROM cdf GROUP BY signal),
spread AS ({union("SELECT '$' AS signal, stddev_pop($) AS ref_std FROM readings")}),
lam AS (SELECT *, sqrt(n_ref * CAST(n_cur AS DOUBLE) / (n_ref + n_cur)) * ks AS lam,
  wasserstein / greatest(ref_std, 0.001e0) AS wasserstein_norm FROM dist JOIN spread USING (signal))"""
_TERMS = " + ".join(
    f"({2 if k % 2 else -2}e0) * exp(-{2 * k * k}e0 * lam * lam)" for k in range(1, 21)
)
_P = f"CASE WHEN lam < 0.2e0 THEN 1e0 ELSE least(1e0, greatest(0e0, {_TERMS})) END"


def _drift_frames(spark, sf_dir):
    df = readings(spark, sf_dir)
    return df, pj.scenario_shift(df.filter("failure_within_h = 1"), SHIFTS)


@query(
    "ks_distance",
    on_readings(
        f"SELECT signal, n_ref, n_cur, {rd('ks')} AS ks, {rd(_P)} AS ks_p_value FROM lam", _CDF
    ),
)
def ks_distance(spark, sf_dir):
    out = dr.distances(*_drift_frames(spark, sf_dir))
    out = out.select("signal", "n_ref", "n_cur", "ks", "ks_p_value")
    return rounded_columns(out, ["ks", "ks_p_value"])


@query(
    "wasserstein_norm",
    on_readings(
        f"SELECT signal, {rd('wasserstein')} AS wasserstein, {rd('ref_std')} AS ref_std, {rd('wasserstein_norm')} AS wasserstein_norm FROM lam",
        _CDF,
    ),
)
def wasserstein_norm(spark, sf_dir):
    out = dr.distances(*_drift_frames(spark, sf_dir))
    out = out.select("signal", "wasserstein", "ref_std", "wasserstein_norm")
    return rounded_columns(out, ["wasserstein", "ref_std", "wasserstein_norm"])


_FLAGGED = f"flagged AS (SELECT *, CASE WHEN n_ref <= 1000 THEN {_P} < 0.05e0 ELSE wasserstein_norm >= 0.1e0 END AS drifted FROM lam)"


@query(
    "drift_decision",
    on_readings(
        """SELECT count(*) FILTER (drifted) AS n_drifted, 9 AS n_features, round(count(*) FILTER (drifted) / 9e0, 6) AS share_drifted,
  round(1e0 / 3e0, 6) AS threshold, count(*) FILTER (drifted) / 9e0 >= 1e0 / 3e0 AS drifted FROM flagged""",
        _CDF,
        _FLAGGED,
    ),
)
def drift_decision(spark, sf_dir):
    out = dr.drift_decision(dr.feature_drift(*_drift_frames(spark, sf_dir)))
    return rounded_columns(out, ["share_drifted", "threshold"])

"""Queries on detectors, models, header matching and streams."""

from __future__ import annotations

import random
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from fleetwise.detectors.joint import (
    IsolationForest,
    MultivariateDetector,
    ReconstructionDetector,
    RobustDistance,
)
from fleetwise.detectors.kernel import KernelReconstructionDetector
from fleetwise.detectors.ladder import SUSPECT, DetectorLadder, SuspectFeature, score_ladder
from fleetwise.functions.scalars import signals_from_map
from fleetwise.learn import contenders as ct
from fleetwise.learn import training as tr
from fleetwise.operators import aggregates as agg
from fleetwise.operators import headers as hd
from fleetwise.operators import projection as pj
from fleetwise.operators import splits as sp
from fleetwise.plans import ceiling as cl
from fleetwise.plans import retrain as rt
from fleetwise.queries.analysis import _ROLLUP, _SHORT, _SPLIT, ROLLUP_SQL, _folds
from fleetwise.queries.base import (
    COLUMNS,
    SCORE,
    on_readings,
    query,
    rd,
    rounded_columns,
    scored,
)
from fleetwise.queries.tables import _PAIRS, _SIGNALS, _WORDS, SHIFTS
from fleetwise.operators.grading import auc_of, horizon_bands
from fleetwise.shared import kept, new_path, scope, stored
from fleetwise.sources.predictions import LOG_SCHEMA
from fleetwise.sources.stand_in import once, once_at, readings, readings_at, table
from fleetwise.spec import DEFAULT, FAILURE_MODES, SEED, SIGNALS
from fleetwise.streaming import jobs as st
from fleetwise.streaming.reorder import reordered_risk_stream as reordered

KEY = DEFAULT.key

def _fine(*scores):
    return reduce(and_, [F.col(c).isNotNull() & F.col(c).between(0.0, 1.0) for c in scores])


def _ranking(df, label, floors):
    """The rows' keys, whether every score is sound, and whether each ranks the label at least as well as its
    floor (an AUC that random scores miss by far). The rows bring their label, which no model looks at."""
    with scope():
        scored_ = stored(df.select(*KEY, *floors, F.col(label).cast("int").alias("_label")), "scored")
        good = all((auc_of(scored_, c, "_label") or 0.0) >= floor for c, floor in floors.items())
        return kept(scored_.select(*KEY, _fine(*floors).alias("sound"), F.lit(good).alias("ranks")), "sound")


_ALL_SOUND = on_readings("SELECT unit_id, t_index, true AS sound, true AS ranks FROM readings")
_TEST_SOUND = on_readings("SELECT unit_id, t_index, true AS sound, true AS ranks FROM halves WHERE split = 'test'", _SPLIT)


def _labelled(spark, sf_dir):
    return readings(spark, sf_dir).select(*KEY, *SIGNALS, DEFAULT.outlier)


def _filled(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return agg.impute(df, agg.signal_medians(df))


# -- detectors -----------------------------------------------------------------------------------


@query("isolation_forest", _ALL_SOUND)
def isolation_forest(spark, sf_dir):
    df = _filled(spark, sf_dir)
    return _ranking(IsolationForest().fit(df).transform(df), DEFAULT.outlier, {"isolation": 0.8})


@query("robust_mahalanobis", _ALL_SOUND)
def robust_mahalanobis(spark, sf_dir):
    """Distances, brought into [0, 1) by d / (1 + d), which keeps their order."""
    df = _filled(spark, sf_dir)
    found = RobustDistance().fit(df).transform(df)
    near = F.col("distance") / (1 + F.col("distance"))
    return _ranking(found.withColumn("distance", near), DEFAULT.outlier, {"distance": 0.95})


@query("multivariate_detector", _ALL_SOUND)
def multivariate_detector(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    model = MultivariateDetector().fit(df)
    return _ranking(model.transform(df), DEFAULT.outlier, {model.name: 0.8})


@query("reconstruction_detector", _ALL_SOUND)
def reconstruction_detector(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    model = ReconstructionDetector().fit(df)
    return _ranking(model.transform(df), DEFAULT.outlier, {model.name: 0.85})


@query("kernel_reconstruction", _ALL_SOUND)
def kernel_reconstruction(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    model = KernelReconstructionDetector().fit(df)
    return _ranking(model.transform(df), DEFAULT.outlier, {model.name: 0.85})


def _train_rows(spark, sf_dir):
    df = sp.grouped_split(readings(spark, sf_dir))
    return tr.side(df, "train").drop("split")


@query("fit_score_ladder", _ALL_SOUND)
def fit_score_ladder(spark, sf_dir):
    """Fitted on the train units, scoring all units."""
    model = DetectorLadder().fit(_train_rows(spark, sf_dir))
    found = model.transform(_labelled(spark, sf_dir))
    return _ranking(found, DEFAULT.outlier, {n: 0.65 for n in model.names})


@query(
    "detector_grades",
    on_readings(
        """SELECT detector, count(*) AS n_rows, true AS ranks, detector = 'temporal' AS finds_stuck, detector = 'reconstruction' AS best_precision
FROM readings, (VALUES ('multivariate'), ('temporal'), ('reconstruction')) AS v(detector) GROUP BY detector"""
    ),
)
def detector_grades(spark, sf_dir):
    """The real ladder graded against the labels, which no detector sees: rank of outliers against a floor, who finds
    stuck sensors, and who has the best average precision."""
    found = score_ladder(readings(spark, sf_dir)).collect()  # one row a detector
    best = max(found, key=lambda r: r["average_precision"])["detector"]
    rows = [(r["detector"], r["n_rows"], 0.65 <= r["roc_auc"] <= 1, r["recall_sensor_stuck"] >= 0.5, r["detector"] == best) for r in found]
    return spark.createDataFrame(rows, "detector string, n_rows long, ranks boolean, finds_stuck boolean, best_precision boolean")


@query("signal_suspect", _ALL_SOUND)
def signal_suspect(spark, sf_dir):
    model = SuspectFeature().fit(_train_rows(spark, sf_dir))
    found = model.transform(_labelled(spark, sf_dir))
    return _ranking(found, DEFAULT.outlier, {SUSPECT: 0.9})


# -- models --------------------------------------------------------------------------------------
# All on the library's defaults: 200 trees, 5 folds, 40 trials, and the boosted contender where the plan's default
# is that; `grouped_cv_auc` and `learning_curve` are the logistic ones that their SQL names.


def _frame(spark, sf_dir):
    return once(
        spark, sf_dir, "modelling", lambda: tr.prepare(readings(spark, sf_dir))[0]
    )


def _boosted(spark, sf_dir):
    return ct.boosted_model().fit(tr.side(_frame(spark, sf_dir), "train"), SIGNALS)


def _scored_test(fitted, spark, sf_dir, floor):
    test = tr.side(_frame(spark, sf_dir), "test")
    return _ranking(fitted.score(test), DEFAULT.target, {"probability": floor})


@query("logreg_model", _TEST_SOUND)
def logreg_model(spark, sf_dir):
    fitted = ct.logreg_model().fit(tr.side(_frame(spark, sf_dir), "train"), SIGNALS)
    return _scored_test(fitted, spark, sf_dir, 0.7)


@query("boosted_model", _TEST_SOUND)
def boosted_model(spark, sf_dir):
    return _scored_test(_boosted(spark, sf_dir), spark, sf_dir, 0.8)


@query("score_batch", on_readings("SELECT unit_id, t_index, true AS sound, true AS ranks, '1' AS model_version FROM readings"))
def score_batch(spark, sf_dir):
    """A model fitted on train units scores every row, with its version beside the score."""
    frame = _frame(spark, sf_dir)
    fitted = ct.logreg_model().fit(tr.side(frame, "train"), SIGNALS)
    out = fitted.score(readings(spark, sf_dir).select(*KEY, *SIGNALS, DEFAULT.target))
    return _ranking(out, DEFAULT.target, {"probability": 0.7}).withColumn("model_version", F.lit("1"))


_FIELD = ", ".join(
    f"({i}, '{c.name}', '{k}', CAST({float(v)!r} AS DOUBLE))" for i, c in enumerate(ct.model_field()) for k, v in c.params.items()
)


@query(
    "model_field",
    on_readings(
        f"""SELECT place, name, param, value, n_rows, n_positive FROM (VALUES {_FIELD}) AS v(place, name, param, value),
  (SELECT count(*) AS n_rows, CAST(sum(failure_within_h) AS BIGINT) AS n_positive FROM halves WHERE split = 'train')""",
        _SPLIT,
    ),
)
def model_field(spark, sf_dir):
    """Every contender by name with the rows and positives it would be fitted on."""
    frame = tr.side(_frame(spark, sf_dir), "train")
    p = ct.profile(frame, SIGNALS, DEFAULT.target)
    rows = [
        (i, c.name, k, float(v), p.rows, p.positives)
        for i, c in enumerate(ct.model_field())
        for k, v in c.params.items()
    ]
    return spark.createDataFrame(
        rows, "place int, name string, param string, value double, n_rows long, n_positive long"
    )


@query(
    "train_compare",
    on_readings(
        """SELECT name, contender_order, true AS ranks, name = 'boosted' AS wins, n_train, n_test FROM (VALUES (0, 'logreg'), (1, 'boosted')) AS v(contender_order, name),
  (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM halves)""",
        _SPLIT,
    ),
)
def train_compare(spark, sf_dir):
    compared = tr.train_compare(readings(spark, sf_dir))
    ranks = F.col("roc_auc") >= F.when(F.col("name") == "boosted", 0.8).otherwise(0.7)
    wins = F.col("name") == compared.winner
    return compared.scores.select("name", "contender_order", ranks.alias("ranks"), wins.alias("wins"), "n_train", "n_test")


@query("grouped_cv_auc", "SELECT 'logreg' AS name, true AS ranks")
def grouped_cv_auc(spark, sf_dir):
    train = tr.side(_frame(spark, sf_dir), "train")
    auc = tr.grouped_cv_auc(ct.logreg_model(), train, SIGNALS)
    return spark.createDataFrame([("logreg", auc is not None and 0.6 <= auc <= 1)], "name string, ranks boolean")


def _points() -> str:
    """The points of the search, by contender and trial, as SQL values."""
    rows = []
    for name in ct.BUILDERS:
        draw = random.Random(f"{SEED}:{name}")
        for trial in range(40):
            p = tr.suggest(name, draw)
            rows.append(f"('{name}', {trial}, {p.get('n_estimators', 'NULL')}, {float(p.get('C', p.get('learning_rate')))!r}e0)")
    return ", ".join(rows)


# Trials by rung: 40 begin, the best 14 of them go on, and 5 of these to the end. Names, trials, points and these counts are stated.
_SEARCH_SQL = f"""SELECT name, trial, n_estimators, scale, 40 AS n_trials, CASE name WHEN 'boosted' THEN 5 ELSE 40 END AS n_ended,
  CASE name WHEN 'boosted' THEN 9 ELSE 0 END AS n_halfway, true AS trees_fit, true AS sound, true AS best_first
FROM (VALUES {_points()}) AS v(name, trial, n_estimators, scale)"""


@query("param_search", _SEARCH_SQL)
def param_search(spark, sf_dir):
    """Both contenders searched at the defaults. ``trees_fit``: a trial's score is from the trees that its rung allows."""
    train = tr.side(_frame(spark, sf_dir), "train")
    dealt = once(spark, sf_dir, "train_folds", lambda: sp.grouped_folds(train))
    rows = []
    for name in ct.BUILDERS:
        found = tr.param_search(name, dealt, SIGNALS)
        last = max(r["rung"] for r in found)
        ended = [r for r in found if r["rung"] == last]
        halfway = [r for r in found if 0 < r["rung"] < last]
        ordered = all(a["cv_auc"] >= b["cv_auc"] for a, b in zip(ended, ended[1:])) and found[: len(ended)] == ended  # noqa: B905
        for r in found:
            p = r["params"]
            n, share = p.get("n_estimators"), tr.RUNG_SHARES[r["rung"]]
            fits = r["trees"] is None if n is None else r["trees"] == max(1, round(n * share))
            sound = r["cv_auc"] is not None and 0.6 <= r["cv_auc"] <= 1
            rows.append((name, r["trial"], n, float(p.get("C", p.get("learning_rate"))), len(found), len(ended), len(halfway), fits, sound, ordered))
    return spark.createDataFrame(
        rows,
        "name string, trial int, n_estimators int, scale double, n_trials int, n_ended int, n_halfway int, trees_fit boolean, sound boolean, best_first boolean",
    )


@query(
    "feature_importance",
    "SELECT 'boosted' AS model, 'gain_share' AS kind, feature, true AS sound, feature IN ('coolant_temp_c', 'oil_pressure_kpa', 'egt_c', 'vibration_mms') AS in_first_four FROM (VALUES {}) AS v(feature)".format(
        ", ".join(f"('{s}')" for s in SIGNALS)
    ),
)
def feature_importance(spark, sf_dir):
    """The four signals that failures move come first."""
    fitted = _boosted(spark, sf_dir)
    first = [f for f, _ in fitted.importance()[:4]]
    sums = sum(v for _, v in fitted.importance())
    sound = F.col("importance").between(0.0, 1.0) & F.lit(abs(sums - 1) < 1e-9)
    return tr.importance_table(spark, fitted).select("model", "kind", "feature", sound.alias("sound"), F.col("feature").isin(first).alias("in_first_four"))


@query(
    "learning_curve",
    "SELECT 'logreg' AS model, share, true AS sound, true AS ranks FROM (VALUES (0.25e0), (0.5e0), (0.75e0), (1e0)) AS v(share)",
)
def learning_curve(spark, sf_dir):
    """Soundness of every share, and that the whole train side ranks the test rows."""
    curve = tr.learning_curve(ct.logreg_model(), _frame(spark, sf_dir), SIGNALS)
    sound = F.coalesce(F.col("train_auc").between(0.0, 1.0) & F.col("test_auc").between(0.0, 1.0), F.lit(True))
    ranks = (F.col("share") < 1.0) | (F.col("test_auc") >= 0.7)
    return curve.select("model", "share", sound.alias("sound"), ranks.alias("ranks"))


_DIAGNOSTICS_SQL = on_readings(
    f"""SELECT 'importance' AS part, {len(SIGNALS)} AS n_rows, true AS sound
UNION ALL SELECT 'learning_curve', 4, true
UNION ALL SELECT 'calibration', n_test, true FROM sizes UNION ALL SELECT 'threshold_sweep', 1, true""",
    _SPLIT,
    "sizes AS (SELECT CAST(count(*) AS INT) AS n_test FROM halves WHERE split = 'test')",
)


@query("write_diagnostics", _DIAGNOSTICS_SQL)
def write_diagnostics(spark, sf_dir):
    """What the four written tables hold: rows of importance and curve; the test rows in all calibration bins, and the sweep's last recall."""
    root, frame, contender = new_path(spark, "diagnostics"), _frame(spark, sf_dir), ct.boosted_model()
    tr.write_diagnostics(root, contender, _boosted(spark, sf_dir), frame, SIGNALS)
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/{name}")
    n = F.count(F.lit(1)).cast("int").alias("n_rows")
    bins, sweep = read("calibration"), read("threshold_sweep")
    share = F.col("importance").between(0.0, 1.0)
    curve = F.coalesce(F.col("test_auc").between(0.0, 1.0), F.lit(True))
    parts = [
        read("importance").agg(F.lit("importance").alias("part"), n, F.min(share).alias("sound")),
        read("learning_curve").agg(F.lit("learning_curve").alias("part"), n, F.min(curve).alias("sound")),
        bins.agg(F.lit("calibration").alias("part"), F.sum("n").cast("int").alias("n_rows"), F.min(F.col("mean_predicted").between(0.0, 1.0)).alias("sound")),
        sweep.agg(F.lit("threshold_sweep").alias("part"), F.max("recall").cast("int").alias("n_rows"), F.min(F.col("precision").between(0.0, 1.0)).alias("sound")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "oof_predictions",
    on_readings(
        "SELECT unit_id, t_index, fold, failure_within_h, true AS sound FROM halves JOIN folds USING (unit_id) WHERE split = 'train'",
        _SPLIT,
        _folds("(SELECT * FROM halves WHERE split = 'train')"),
    ),
)
def oof_predictions(spark, sf_dir):
    train = tr.side(_frame(spark, sf_dir), "train")
    out = tr.oof_predictions(ct.boosted_model(), train, SIGNALS)
    fine = F.col("probability").isNull() | F.col("probability").between(0.0, 1.0)
    return out.select(*KEY, "fold", F.col("failure_within_h").cast("int").alias("failure_within_h"), fine.alias("sound"))


def _base(spark, sf_dir):
    frame = once(
        spark, sf_dir, "base", lambda: cl.build_base(readings(spark, sf_dir)).frame
    )
    return cl.Base(
        frame,
        {cl.RUNGS[0]: SIGNALS, cl.RUNGS[1]: tuple(cl.temporal_columns(DEFAULT))},
    )


_RUNG_ROWS = ", ".join(f"('{r}')" for r in (*cl.RUNGS, "stack"))


@query("stacking_probe", f"SELECT rung, true AS ranks FROM (VALUES {_RUNG_ROWS}) AS v(rung)")
def stacking_probe(spark, sf_dir):
    probe = cl.stacking_probe(_base(spark, sf_dir), ct.boosted_model())
    return probe.select("rung", F.col("roc_auc").between(0.8, 1.0).alias("ranks"))


@query("upper_bound", "SELECT true AS near_one, true AS diagnostic")
def upper_bound(spark, sf_dir):
    base, contender = _base(spark, sf_dir), ct.boosted_model()
    overall, _, _ = cl.decompose(base, contender)
    bound = cl.upper_bound(base, contender, overall)
    return bound.select((F.col("leaky_auc") > 0.99).alias("near_one"), "diagnostic")


_CEILING = [
    *[("horizon", n) for n in horizon_bands()],
    *[("mode", m) for m in FAILURE_MODES],
    *[("stacking", r) for r in (*cl.RUNGS, "stack")],
    ("diagnostic", "upper_bound"),
]


@query("ceiling_report", "SELECT part, name, true AS fits FROM (VALUES {}) AS v(part, name)".format(", ".join(f"('{p}', '{n}')" for p, n in _CEILING)))
def ceiling_report(spark, sf_dir):
    """Every figure of the report against what must hold: rungs and the stack above 0.75, the bound near 1, slices undefined or from 0 to 1."""
    report = cl.ceiling_report(readings(spark, sf_dir))
    part = lambda df, kind, name: df.select(
        F.lit(kind).alias("part"), F.col(name).alias("name"), "roc_auc"
    )
    bound = report.bound.select(
        F.lit("diagnostic").alias("part"),
        F.lit("upper_bound").alias("name"),
        F.col("leaky_auc").alias("roc_auc"),
    )
    whole = (
        part(report.by_horizon, "horizon", "slice")
        .unionByName(part(report.by_mode, "mode", "slice"))
        .unionByName(part(report.stacking, "stacking", "rung"))
        .unionByName(bound)
    )
    least = F.when(F.col("part") == "stacking", 0.75).when(F.col("part") == "diagnostic", 0.99).otherwise(0.0)
    slice_ = F.col("part").isin("horizon", "mode") & F.col("roc_auc").isNull()
    return whole.select("part", "name", (slice_ | F.coalesce(F.col("roc_auc").between(least, F.lit(1.0)), F.lit(False))).alias("fits"))


@query(
    "temporal_ladder",
    "SELECT rung, true AS ranks, true AS margin_fits, 1 AS n_winners FROM (VALUES {}) AS v(rung)".format(
        ", ".join(f"('{r}')" for r in (*cl.RUNGS, "sequence"))
    ),
)
def temporal_ladder(spark, sf_dir):
    """Each rung's rank of the test rows against a floor, and the margin of the window model over the temporal one."""
    found = {r["rung"]: r for r in cl.temporal_ladder(readings(spark, sf_dir)).collect()}
    margin = found["sequence"]["roc_auc"] - found[cl.RUNGS[1]]["roc_auc"]
    fits = found["sequence"]["margin_over_temporal"] == margin
    wins = sum(r["winner"] for r in found.values())
    rows = [(rung, (0.6 if rung == "sequence" else 0.75) <= r["roc_auc"] <= 1, fits, wins) for rung, r in found.items()]
    return spark.createDataFrame(rows, "rung string, ranks boolean, margin_fits boolean, n_winners int")


@query(
    "drift_retrain_job",
    """SELECT true AS drifted, 'failure_model' AS name, 2 AS version, true AS ranks, false AS forced, 1 AS incumbent_version,
  0.6e0 AS incumbent_auc, true AS promoted, 'passed' AS reason""",
)
def drift_retrain_job(spark, sf_dir):
    """Drift on shifted readings, retraining on them, and the gate against a live version."""
    reference = readings(spark, sf_dir)
    current = pj.scenario_shift(reference, SHIFTS)
    live = spark.createDataFrame(
        [("failure_model", 1, 0.6)], "name string, live_version long, live_auc double"
    )
    result = rt.drift_retrain_job(reference, current, live, clean=False)
    drifted = F.lit(bool(result.decision.first()["drifted"])).alias("drifted")
    ranks = F.col("roc_auc").between(0.75, 1.0).alias("ranks")
    return result.promotion.select(drifted, "name", "version", ranks, "forced", "incumbent_version", "incumbent_auc", "promoted", "reason")


# -- headers -------------------------------------------------------------------------------------


def header_catalogue(spark, sf_dir):
    """Every document as a file whose headers are its words, in order."""
    words = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split(F.col("text"), r"\s+", -1)).alias("position", "header")
    )
    return words


_MATCH = f"""WITH RECURSIVE listed AS (SELECT doc_id, header, min(position) AS position FROM (
  SELECT doc_id, unnest(w) AS header, generate_subscripts(w, 1) - 1 AS position FROM (
    SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents)) GROUP BY doc_id, header),
names AS (SELECT DISTINCT header FROM listed), {_SIGNALS}, {_WORDS},
scores AS (SELECT * FROM ({_PAIRS.replace("$near", "1e0 - levenshtein(s, h) / CAST(greatest(length(s), length(h)) AS DOUBLE)")}) WHERE score >= 0.6e0),
pairs AS (SELECT doc_id, signal, l.header, score, position,
  list_position([{", ".join(f"'{s}'" for s in SIGNALS)}], signal) AS place FROM listed l JOIN scores s ON s.header = l.header),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, signal ORDER BY score DESC, position) <= {len(SIGNALS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, position) AS r FROM best),
walk(doc_id, r, signals, headers, took) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM ranked
  UNION ALL
  SELECT w.doc_id, p.r,
    CASE WHEN list_contains(w.signals, p.signal) OR list_contains(w.headers, p.header) THEN w.signals ELSE list_append(w.signals, p.signal) END,
    CASE WHEN list_contains(w.signals, p.signal) OR list_contains(w.headers, p.header) THEN w.headers ELSE list_append(w.headers, p.header) END,
    NOT (list_contains(w.signals, p.signal) OR list_contains(w.headers, p.header))
  FROM walk w JOIN ranked p ON p.doc_id = w.doc_id AND p.r = w.r + 1)
SELECT p.doc_id, p.signal, p.header, {rd("p.score")} AS score FROM walk w JOIN ranked p ON p.doc_id = w.doc_id AND p.r = w.r WHERE w.took"""


@query("match_headers", _MATCH)
def match_headers(spark, sf_dir):
    out = hd.match_headers(header_catalogue(spark, sf_dir), "doc_id", "header", "position")
    return rounded_columns(out, ["score"])


# -- streams -------------------------------------------------------------------------------------


@query(
    "score_stream",
    on_readings(
        f"SELECT CAST(timestamp_h * 3600e0 AS BIGINT) AS created_at, '3' AS model_version, score AS failure_probability, {COLUMNS} FROM scored"
    ),
)
def score_stream(spark, sf_dir):
    path, schema = readings_at(spark, sf_dir)
    log = new_path(spark, "stream_log")
    st.score_stream(
        st.reading_stream(spark, path, schema),
        lambda df: df.withColumn("score", F.expr(SCORE)),
        "score",
        "3",
        log,
        new_path(spark, "stream_state"),
        created_at=st.event_time(),
    ).awaitTermination()
    rows = spark.read.schema(LOG_SCHEMA).parquet(log)
    return rows.select(
        F.unix_seconds("created_at").alias("created_at"),
        "model_version",
        "failure_probability",
        *signals_from_map(F.col("readings"), SIGNALS),
    )


@query(
    "quality_stream",
    on_readings(
        f"""SELECT w AS window_start, n AS n_rows, {rd('rate')} AS suspect_rate, rate > 3e0 * 0.05e0 AS tripped FROM (
  SELECT CAST(floor(timestamp_h / 6e0) * 21600 AS BIGINT) AS w, count(*) AS n,
  avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS rate FROM scored GROUP BY 1)
WHERE w + 21600 <= (SELECT max(timestamp_h) * 3600e0 - 3600e0 FROM readings)"""
    ),
)
def quality_stream(spark, sf_dir):
    """Six-hour windows that the watermark has closed."""
    path, schema = readings_at(spark, sf_dir)
    out = new_path(spark, "stream_quality")
    st.quality_stream(
        st.reading_stream(spark, path, schema),
        F.expr(SCORE),
        0.05,
        out,
        new_path(spark, "stream_state"),
        every="6 hours",
    ).awaitTermination()
    rows = spark.read.parquet(out).select(
        F.unix_seconds("window_start").alias("window_start"), "n_rows", "suspect_rate", "tripped"
    )
    return rounded_columns(rows, ["suspect_rate"])


@query("sustained_risk_stream", on_readings(ROLLUP_SQL + " FROM rolled", _SHORT, _ROLLUP))
def sustained_risk_stream(spark, sf_dir):
    make = lambda: scored(spark, sf_dir).select(*KEY, "score")
    path, schema = once_at(spark, sf_dir, "scored", make)
    out = new_path(spark, "stream_risk")
    st.sustained_risk_stream(
        st.reading_stream(spark, path, schema), "score", out, new_path(spark, "stream_state")
    ).awaitTermination()
    risks = st.unit_risk(spark.read.parquet(out))
    return rounded_columns(risks, ["risk", "high_risk_share"])


_LATENESS_H = 24
_BEFORE = f"(SELECT * FROM sustained WHERE timestamp_h <= (SELECT max(timestamp_h) FROM readings) - {_LATENESS_H}e0)"


@query("reordered_risk_stream", on_readings(ROLLUP_SQL + " FROM rolled", _SHORT, _ROLLUP.replace("FROM sustained", f"FROM {_BEFORE}")))
def reordered_risk_stream(spark, sf_dir):
    """Every reading is up to 19 hours late, in three deliveries; what the watermark has passed is rolled up."""
    rows = scored(spark, sf_dir).select(*KEY, "timestamp_h", "score")
    arrival = F.col("timestamp_h") + F.pmod(F.xxhash64(*KEY), F.lit(20))
    third = rows.agg(F.max("timestamp_h")).first()[0] / 3
    source, out, state = (new_path(spark, n) for n in ("stream_late", "stream_risk", "stream_state"))
    for i in range(3):
        due = (arrival >= i * third) if i else F.lit(True)
        part = rows.where(due & (arrival < (i + 1) * third if i < 2 else F.lit(True)))
        part.orderBy(F.xxhash64(*KEY)).write.mode("append").parquet(source)
        stream = st.reading_stream(spark, source, rows.schema)
        reordered(stream, "score", out, state, lateness_h=_LATENESS_H).awaitTermination()
    return rounded_columns(st.unit_risk(spark.read.parquet(out)), ["risk", "high_risk_share"])

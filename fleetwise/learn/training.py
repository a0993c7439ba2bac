"""Comparing contenders on unit-disjoint splits, searching their parameters, diagnosing fits."""

from __future__ import annotations

import math
import operator
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.detectors.joint import TREES
from fleetwise.detectors.ladder import SUSPECT, SuspectFeature
from fleetwise.learn import boosting as bo
from fleetwise.learn.contenders import BUILDERS, BoostedContender, Contender, Fitted, LogisticContender, model_field
from fleetwise.learn.logistic import fit_many
from fleetwise.learn.logistic import held_scores as logistic_scores
from fleetwise.operators.grading import (
    DegenerateSplit,
    audit_fit,
    auc_of,
    calibration,
    roc_auc,
    threshold_sweep,
)
from fleetwise.operators.ordered import running_totals
from fleetwise.operators.projection import assert_no_leakage
from fleetwise.operators.splits import grouped_folds, grouped_split, unit_draw
from fleetwise.plans.promotion import best_run
from fleetwise.shared import scope, stored, together
from fleetwise.spec import DEFAULT, FOLDS, SEED, TelemetrySpec

CURVE_SHARES = (0.25, 0.5, 0.75, 1.0)
RUNG_SHARES = (1 / 9, 1 / 3, 1.0)  # of a trial's trees, after which the worse trials stop
KEEP_ONE_OF = 3
CURVE_SCHEMA = "model string, share double, train_auc double, test_auc double"
SCORE_SCHEMA = "name string, contender_order int, roc_auc double, n_train long, n_test long"


def side(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def prepare(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    seed: int = SEED,
    clean: bool = False,
    trees: int = TREES,
) -> tuple[DataFrame, list[str]]:
    """The split modelling frame, written once, and its feature names.

    ``clean`` adds the suspicion feature, fitted on the train units alone.
    """
    split = grouped_split(df.select(*spec.key, *spec.signals, spec.target), spec, seed=seed)
    features = list(spec.signals)
    if clean:
        split = stored(split, "split")
        suspect = SuspectFeature(spec, trees=trees, seed=seed).fit(side(split, "train"))
        split = suspect.transform(split)
        features.append(SUSPECT)
    return stored(split, "modelling"), features


@dataclass(frozen=True)
class Comparison:
    scores: DataFrame  # one row per contender
    winner: str
    models: Mapping[str, Fitted]
    frame: DataFrame
    features: list[str]


def train_compare(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    seed: int = SEED,
    tuned: Mapping[str, Mapping[str, object]] | None = None,
    clean: bool | None = None,
    audit: bool = False,
    diagnose_to: str | None = None,
    trees: int = TREES,
) -> Comparison:
    """Fit every contender on the train units, score the test units, name the best.

    The clean frame is the default when tuned parameters are given. ``audit`` raises on an
    overfitted or useless model, ``diagnose_to`` writes the diagnostics there.
    """
    clean = tuned is not None if clean is None else clean
    frame, features = prepare(df, spec, seed=seed, clean=clean, trees=trees)
    train, test = side(frame, "train"), side(frame, "test")
    n_train, n_test = train.count(), test.count()
    models, rows = {}, []
    for place, contender in enumerate(model_field(seed, tuned)):
        fitted = contender.fit(train, features, spec)
        auc = auc_of(fitted.score(test), "probability", spec.target, strict=True)
        models[contender.name] = fitted
        rows.append((contender.name, place, auc, n_train, n_test))
        if audit:
            audit_contender(contender, fitted, train, features, auc, spec, strict=True)
        if diagnose_to:
            write_diagnostics(diagnose_to, contender, fitted, frame, features, spec)
    scores = df.sparkSession.createDataFrame(rows, SCORE_SCHEMA)
    top = best_run(scores.withColumn("_all", F.lit(1)), by="_all").first()["name"]
    return Comparison(scores, top, models, frame, features)


def oof_predictions(
    contender: Contender,
    train: DataFrame,
    features: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    folds: int = FOLDS,
    out: str = "probability",
    parallelism: int = 4,
) -> DataFrame:
    """Every train row scored by a model that never saw its unit. Rows may bring their ``fold``.

    A fold whose other units hold one class cannot be fitted; its rows get NULL.
    """
    dealt = train if "fold" in train.columns else stored(grouped_folds(train, spec, folds=folds), "folds")
    numbers = sorted(r[0] for r in dealt.select("fold").distinct().collect())  # at most `folds`
    if isinstance(contender, BoostedContender):
        models = contender.fit_folds(dealt, features, spec, folds=numbers)
        return dealt.withColumn(out, bo.scores(models)(F.col("fold").cast("int"), *[F.col(c).cast("double") for c in features]))

    def one(k: int) -> DataFrame:
        held, rest = dealt.filter(F.col("fold") == k), dealt.filter(F.col("fold") != k)
        try:
            return contender.fit(rest, features, spec).score(held, out)
        except DegenerateSplit:
            return held.withColumn(out, F.lit(None).cast("double"))

    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, numbers)))


def grouped_cv_auc(
    contender: Contender,
    train: DataFrame,
    features: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    folds: int = FOLDS,
) -> float | None:
    """Mean AUC over the folds, all graded in one job; one-class folds are skipped.

    Logistic models of all folds are fitted in the same passes over the rows, of which only features, label and fold are stored.
    """
    if isinstance(contender, LogisticContender):
        assert_no_leakage(features, spec)
        with scope():
            dealt = train if "fold" in train.columns else grouped_folds(train, spec, folds=folds)
            rows = stored(dealt.select(*[F.col(c).cast("double").alias(c) for c in features], spec.target, "fold"), "folds")
            numbers = sorted(r[0] for r in rows.select("fold").distinct().collect())  # at most `folds`
            wanted = [(float(contender.params["C"]), k) for k in numbers]
            scale, beta = fit_many(rows, features, spec.target, wanted)
            scored = logistic_scores(rows, features, spec.target, wanted, scale, beta)
            return _mean_auc(scored, dict.fromkeys(range(len(wanted)), 0)).get(0)
    oof =oof_predictions(contender, train, features, spec, folds=folds)
    graded = roc_auc(oof.filter(F.col("probability").isNotNull()), "probability", spec.target, ["fold"])
    return graded.agg(F.avg("roc_auc")).first()[0]


def suggest(name: str, draw: random.Random) -> dict[str, object]:
    """One random point of a contender's search space."""
    log_uniform = lambda low, high: math.exp(draw.uniform(math.log(low), math.log(high)))
    if name == "logreg":
        return {"C": log_uniform(1e-3, 1e2)}
    return {
        "n_estimators": draw.randrange(100, 601, 50),
        "learning_rate": log_uniform(0.01, 0.2),
        "num_leaves": draw.randint(15, 127),
        "min_child_samples": draw.randint(10, 100),
        "reg_lambda": log_uniform(1e-3, 10.0),
    }


def _mean_auc(scored: DataFrame, trial_of: Mapping[int, int]) -> dict[int, float]:
    """The mean over folds of each trial's AUC on held-out rows; one-class folds are skipped."""
    graded = roc_auc(scored, "score", "y", ["model"]).collect()  # one row a trial and fold
    found: dict[int, list[float]] = {}
    for r in graded:
        if r["roc_auc"] is not None:
            found.setdefault(trial_of[r["model"]], []).append(r["roc_auc"])
    return {k: sum(v) / len(v) for k, v in found.items()}


def param_search(
    name: str,
    train: DataFrame,
    features: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    trials: int = 40,
    folds: int = FOLDS,
    seed: int = SEED,
    rungs: Sequence[float] = RUNG_SHARES,
    keep: int = KEEP_ONE_OF,
) -> list[dict]:
    """Seeded random search on the train units, best trial first. Rows may bring their ``fold``.

    Logistic trials are fitted together to their end. Boosted trials are halved: all get the first share of
    their trees, the best one of ``keep`` go on from the trees they have, and so on; the models of a rung are
    grown in the same job. A result says how many ``trees`` its score is from; trials that got further come first.
    """
    assert_no_leakage(features, spec)
    draw = random.Random(f"{seed}:{name}")
    points = [suggest(name, draw) for _ in range(trials)]
    with scope():
        dealt = train if "fold" in train.columns else stored(grouped_folds(train, spec, folds=folds), "folds")
        numbers = sorted(r[0] for r in dealt.select("fold").distinct().collect())  # at most `folds`
        if name == "logreg":
            wanted = [(float(p["C"]), k) for p in points for k in numbers]
            scale, beta = fit_many(dealt, features, spec.target, wanted)
            scored = logistic_scores(dealt, features, spec.target, wanted, scale, beta)
            aucs = _mean_auc(scored, {m: m // len(numbers) for m in range(len(wanted))})
            results = [{"name": name, "trial": k, "cv_auc": aucs.get(k), "trees": None, "params": p, "rung": 0} for k, p in enumerate(points)]
        else:
            results = _halved(name, dealt, features, spec, points, numbers, seed, rungs, keep)
    return sorted(results, key=lambda r: (r["rung"], -math.inf if r["cv_auc"] is None else r["cv_auc"]), reverse=True)


def _halved(name, dealt, features, spec, points, numbers, seed, rungs, keep) -> list[dict]:
    data = bo.table(dealt, features, spec.target, "fold")
    contenders = [BUILDERS[name](seed, p) for p in points]
    wanted = [(c.params, k) for c in contenders for k in numbers]
    trial_of = {m: m // len(numbers) for m in range(len(wanted))}
    state = bo.models(dealt.sparkSession, wanted)
    results = {k: {"name": name, "trial": k, "cv_auc": None, "trees": 0, "params": p, "rung": 0} for k, p in enumerate(points)}
    alive = list(results)
    for rung, share in enumerate(rungs):
        state = bo.advance(state, data, share)
        aucs = _mean_auc(bo.held_scores(state, data), trial_of)
        for k in alive:
            trees = max(1, round(contenders[k].params["n_estimators"] * share))
            results[k] |= {"cv_auc": aucs.get(k), "trees": trees, "rung": rung}
        alive = sorted((k for k in alive if k in aucs), key=lambda k: (-aucs[k], k))[: -(-len(alive) // keep)]
        state = state.where(F.col("model").isin([m for m, k in trial_of.items() if k in alive]))
    return list(results.values())


def learning_curve(
    contender: Contender,
    frame: DataFrame,
    features: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    shares: Sequence[float] = CURVE_SHARES,
    seed: int = SEED,
) -> DataFrame:
    """Train and test AUC over growing subsets of whole train units, each inside the next.

    A share whose units hold one class has no model and NULL for both. Logistic models of all shares are fitted in the same
    passes over one stored table.
    """
    train, test = side(frame, "train"), side(frame, "test")
    units = train.select(spec.unit).distinct().withColumn("_draw", unit_draw(spec, seed + 1))
    placed = running_totals(units.withColumn("n", F.lit(1).cast("bigint")), [], "_draw", ["n"])
    placed = stored(placed.select(spec.unit, "cum_n", "all_n"), "curve")

    if isinstance(contender, LogisticContender):
        assert_no_leakage(features, spec)
        dealt = train.select(spec.unit, *features, spec.target).join(_first_share(placed, shares, spec), spec.unit)
        rows = _shared_curve(contender, dealt, test, features, spec, shares)
        return frame.sparkSession.createDataFrame(rows, CURVE_SCHEMA)

    def point(share: float) -> tuple:
        chosen = placed.filter(_within(share))
        part = train.join(chosen.select(spec.unit), spec.unit, "left_semi")
        try:
            fitted = contender.fit(part, features, spec)
        except DegenerateSplit:
            return contender.name, float(share), None, None
        return (
            contender.name,
            float(share),
            auc_of(fitted.score(part), "probability", spec.target),
            auc_of(fitted.score(test), "probability", spec.target),
        )

    rows = together([lambda s=s: point(s) for s in shares])
    return frame.sparkSession.createDataFrame(rows, CURVE_SCHEMA)


def _within(share: float):
    return F.col("cum_n") <= F.greatest(F.lit(2), F.ceil(F.col("all_n") * share))


def _first_share(placed: DataFrame, shares: Sequence[float], spec: TelemetrySpec) -> DataFrame:
    """The units with, as their ``fold``, the number of the smallest share that holds them; units of no share are left out."""
    first = F.coalesce(*[F.when(_within(s), F.lit(k)) for k, s in enumerate(sorted(set(shares)))])
    return placed.select(spec.unit, first.alias("fold")).where(F.col("fold").isNotNull())


def _shared_curve(contender, train: DataFrame, test: DataFrame, features, spec: TelemetrySpec, shares) -> list[tuple]:
    """The curve's points; a model of share k sees the rows whose ``fold`` is at most k."""
    order = sorted(set(shares))
    wanted = [(float(contender.params["C"]), k) for k in range(len(order))]
    values = [F.col(c).cast("double").alias(c) for c in features]
    hit = F.when(F.col(spec.target).cast("int") == 1, 1).otherwise(0).alias(spec.target)  # as AUCs count
    with scope():
        rows = stored(train.select(*values, spec.target, "fold"), "curve_rows")
        scale, beta = fit_many(rows, features, spec.target, wanted, operator.le)
        aucs = []
        for part in (rows.select(*features, hit, "fold"), test.select(*values, hit, F.lit(-1).alias("fold"))):
            scored = logistic_scores(part, features, spec.target, wanted, scale, beta, operator.le)
            aucs.append(_mean_auc(scored, {k: k for k in range(len(order))}))
    return [(contender.name, float(s), *[a.get(order.index(s)) for a in aucs]) for s in shares]


def importance_table(spark, fitted: Fitted) -> DataFrame:
    kind = "abs_coefficient" if fitted.name == "logreg" else "gain_share"
    rows = [(fitted.name, kind, f, v) for f, v in fitted.importance()]
    return spark.createDataFrame(rows, "model string, kind string, feature string, importance double")


def audit_contender(
    contender: Contender,
    fitted: Fitted,
    train: DataFrame,
    features: Sequence[str],
    test_auc: float,
    spec: TelemetrySpec = DEFAULT,
    *,
    folds: int = FOLDS,
    strict: bool = False,
) -> DataFrame:
    train_auc = auc_of(fitted.score(train), "probability", spec.target)
    cv_auc = grouped_cv_auc(contender, train, features, spec, folds=folds)
    row = [(contender.name, train_auc, cv_auc, test_auc)]
    aucs = train.sparkSession.createDataFrame(
        row, "model string, train_auc double, cv_auc double, test_auc double"
    )
    return audit_fit(aucs, strict=strict)


def write_diagnostics(
    root: str,
    contender: Contender,
    fitted: Fitted,
    frame: DataFrame,
    features: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    curve_shares: Sequence[float] = CURVE_SHARES,
) -> None:
    """Importance, calibration, sweep and learning curve as CSV, one folder per model."""
    spark = frame.sparkSession
    scored = stored(
        fitted.score(side(frame, "test")).select("probability", spec.target), "scored"
    )
    tables = {
        "importance": importance_table(spark, fitted).drop("model"),
        "calibration": calibration(scored, "probability", spec.target),
        "threshold_sweep": threshold_sweep(scored, "probability", spec.target),
        "learning_curve": learning_curve(
            contender, frame, features, spec, shares=curve_shares
        ).drop("model"),
    }
    for name, rows in tables.items():
        rows.withColumn("model", F.lit(contender.name)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).option("header", True).partitionBy("model").csv(f"{root.rstrip('/')}/{name}")

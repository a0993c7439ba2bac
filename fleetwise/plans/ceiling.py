"""Where the predictability lives: by time to failure, by mode, above the bound, across rungs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.functions.scalars import finite_or, one_hot
from fleetwise.learn.contenders import Contender, Fitted, boosted_model, convolution_model, stack_model
from fleetwise.learn.convolution import convolved
from fleetwise.learn.training import oof_predictions, side
from fleetwise.operators.aggregates import signal_moments
from fleetwise.operators.grading import (
    DegenerateSplit,
    auc_by_horizon,
    auc_by_mode,
    auc_of,
    seen_modes,
)
from fleetwise.operators.projection import assert_honest, assert_no_leakage
from fleetwise.operators.rollup import join_scores
from fleetwise.operators.splits import grouped_folds, grouped_split
from fleetwise.operators.windows import (
    temporal_columns,
    temporal_features,
    time_to_failure,
    window_tensor,
)
from fleetwise.shared import stored, together
from fleetwise.spec import DEFAULT, FOLDS, SEED, TelemetrySpec

FAR = 1e9  # stands for "no failure ahead" in the diagnostic frame
RUNGS = ("boosted_perrow", "boosted_temporal")  # as they are called with the default contender


def rung_name(rung: str, contender: Contender) -> str:
    """The rung named after the model that is fitted on it."""
    return rung.replace("boosted", contender.name, 1) if rung in RUNGS else rung


@dataclass(frozen=True)
class Base:
    """The split frame with raw and temporal features, written once for all instruments."""

    frame: DataFrame
    features: Mapping[str, tuple[str, ...]]


def build_base(df: DataFrame, spec: TelemetrySpec = DEFAULT, *, seed: int = SEED) -> Base:
    features = {RUNGS[0]: spec.signals, RUNGS[1]: tuple(temporal_columns(spec))}
    for columns in features.values():
        assert_honest(columns, spec)
    labels = [spec.clock, spec.target, spec.mode]
    wide = temporal_features(df, spec, keep=labels)
    split = stored(grouped_split(wide, spec, seed=seed), "base")
    test = side(split, "test").agg(F.min(spec.target), F.max(spec.target)).first()
    if test[0] == test[1]:
        raise DegenerateSplit("the test units hold one class")
    return Base(split, features)


def decompose(
    base: Base, contender: Contender, spec: TelemetrySpec = DEFAULT, *, fitted: Fitted | None = None
) -> tuple[float, DataFrame, DataFrame]:
    """Overall AUC of the per-row rung, and its AUC by horizon and by mode. ``fitted``: that rung, if at hand."""
    fitted = fitted or contender.fit(side(base.frame, "train"), base.features[RUNGS[0]], spec)
    timed = time_to_failure(base.frame, spec)
    scored = fitted.score(side(timed, "test")).select(
        "probability", "time_to_failure_h", spec.target, spec.mode
    )
    scored = stored(scored, "decomposed")
    return (
        auc_of(scored, "probability", spec.target),
        auc_by_horizon(scored, "probability", spec),
        auc_by_mode(scored, "probability", spec),
    )


def upper_bound(
    base: Base, contender: Contender, honest_auc: float, spec: TelemetrySpec = DEFAULT
) -> DataFrame:
    """A diagnostic model that sees the failure mode and the time to failure. Never a result."""
    return _bound(base, honest_auc, _leaky_auc(base, contender, spec))


def _bound(base: Base, honest_auc: float, auc: float) -> DataFrame:
    row = [(honest_auc, auc, auc - honest_auc, True)]
    return base.frame.sparkSession.createDataFrame(
        row, "honest_auc double, leaky_auc double, gap double, diagnostic boolean"
    )


def _leaky_auc(base: Base, contender: Contender, spec: TelemetrySpec) -> float:
    modes = seen_modes(base.frame, spec)
    timed = time_to_failure(base.frame, spec)
    leaky = timed.select(
        *spec.key,
        "split",
        F.col(spec.target).alias("_answer"),
        *spec.signals,
        finite_or(F.col("time_to_failure_h"), FAR).alias("time_to_failure_h"),
        *one_hot(spec.mode, modes),
    )
    columns = [*spec.signals, "time_to_failure_h", *[f"{spec.mode}__{m}" for m in modes]]
    assert_no_leakage(columns, spec)
    fitted = contender.fit(side(leaky, "train"), columns, spec, label="_answer")
    return auc_of(fitted.score(side(leaky, "test")), "probability", "_answer")


def stacking_probe(
    base: Base,
    contender: Contender,
    spec: TelemetrySpec = DEFAULT,
    *,
    folds: int = FOLDS,
    seed: int = SEED,
    external: Mapping[str, tuple[DataFrame, DataFrame]] | None = None,
    fitted: Mapping[str, Fitted] | None = None,
) -> DataFrame:
    """Does a logistic over out-of-fold scores beat the best rung on the test units?

    ``external`` adds rungs scored elsewhere: ``name -> (train scores, test scores)``, each a frame
    of row key and ``probability`` that must cover exactly the rows of its side. ``fitted`` has fits on all
    train rows by rung, as far as they are at hand. Folds are dealt once for all rungs, and all fits run at the same time.
    """
    key = list(spec.key)
    labels = base.frame.select(*key, "split", spec.target)
    train, test = side(labels, "train"), side(labels, "test")
    dealt = stored(grouped_folds(side(base.frame, "train"), spec, folds=folds), "folds")
    columns = {rung: list(dict.fromkeys([*key, spec.target, *features])) for rung, features in base.features.items()}

    def held_out(rung: str) -> DataFrame:
        part = dealt.select(*columns[rung], "fold")
        return oof_predictions(contender, part, base.features[rung], spec, folds=folds, out=rung_name(rung, contender))

    rungs = list(base.features)
    found = together([
        *[lambda r=r: held_out(r) for r in rungs],
        *[lambda r=r: (fitted or {}).get(r) or contender.fit(side(base.frame, "train"), base.features[r], spec) for r in rungs],
    ])
    names = []
    for rung, oof, model in zip(rungs, found, found[len(rungs) :], strict=False):
        name = rung_name(rung, contender)
        full = model.score(side(base.frame, "test").select(*columns[rung]), name)
        train = train.join(oof.select(*key, name), key)
        test = test.join(full.select(*key, name), key)
        names.append(name)
    for name, (on_train, on_test) in (external or {}).items():
        pick = lambda df: df.select(*key, F.col("probability").alias(name))
        train = join_scores(train, pick(on_train), spec)
        test = join_scores(test, pick(on_test), spec)
        names.append(name)
    train, test = stored(train.dropna(subset=names), "stack_train"), stored(test, "stack_test")
    alone = {n: auc_of(test, n, spec.target) for n in names}
    meta = stack_model(seed).fit(train, names, spec)
    stack = auc_of(meta.score(test), "probability", spec.target)
    best = max(names, key=lambda n: alone[n])
    rows = [(n, alone[n], n == best, None, None) for n in names]
    margin = stack - alone[best]
    rows.append(("stack", stack, False, margin, margin > 0))
    return base.frame.sparkSession.createDataFrame(
        rows, "rung string, roc_auc double, best_base boolean, margin double, beats_best boolean"
    )


@dataclass(frozen=True)
class CeilingReport:
    overall: float
    by_horizon: DataFrame
    by_mode: DataFrame
    bound: DataFrame
    stacking: DataFrame

    @property
    def ceiling_is_data(self) -> bool:
        """No gain from stacking: the rungs know the same things."""
        return not self.stacking.filter(F.col("rung") == "stack").first()["beats_best"]


def ceiling_report(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    contender: Contender | None = None,
    folds: int = FOLDS,
    seed: int = SEED,
    external: Mapping[str, tuple[DataFrame, DataFrame]] | None = None,
) -> CeilingReport:
    contender = contender or boosted_model(seed)
    base = build_base(df, spec, seed=seed)
    fits = [lambda f=f: contender.fit(side(base.frame, "train"), f, spec) for f in base.features.values()]
    *models, leaky = together([*fits, lambda: _leaky_auc(base, contender, spec)])
    fitted = dict(zip(base.features, models, strict=True))
    overall, by_horizon, by_mode = decompose(base, contender, spec, fitted=fitted[RUNGS[0]])
    bound = _bound(base, overall, leaky)
    stacking = stacking_probe(base, contender, spec, folds=folds, seed=seed, external=external, fitted=fitted)
    return CeilingReport(overall, by_horizon, by_mode, bound, stacking)


def train_scaled_windows(
    df: DataFrame, spec: TelemetrySpec, train: DataFrame, keep: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """The window tensor, scaled on train rows, and the names of its array columns."""
    moments = signal_moments(train, spec, sample=False)
    tensor = window_tensor(df, moments.centre, moments.scale, spec, keep=keep)
    return tensor, [f"{s}__{kind}" for s in spec.signals for kind in ("values", "present")]


def temporal_ladder(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    contender: Contender | None = None,
    sequence: Contender | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Per-row, temporal and window model on the same test rows, with the window model's margin.

    The window model is a logistic over random convolutions; a ``sequence`` contender takes the bare window arrays.
    """
    contender = contender or boosted_model(seed)
    base = build_base(df, spec, seed=seed)
    train, test = side(base.frame, "train"), side(base.frame, "test")
    fits = together([lambda f=f: contender.fit(train, f, spec) for f in base.features.values()])
    aucs = {}
    for rung, fitted in zip(base.features, fits, strict=True):
        aucs[rung_name(rung, contender)] = auc_of(fitted.score(test), "probability", spec.target)
    rows = base.frame.select(*spec.key, "split", *spec.signals, spec.target)
    windows, arrays = train_scaled_windows(
        rows, spec, side(rows, "train"), ["split", spec.target]
    )
    if sequence is None:
        sequence, arrays = convolution_model(seed), ["shapes"]
        windows = stored(convolved(windows, spec, seed=seed), "shapes")
    fitted = sequence.fit(side(windows, "train"), arrays, spec)
    aucs["sequence"] = auc_of(fitted.score(side(windows, "test")), "probability", spec.target)
    margin = aucs["sequence"] - aucs[rung_name(RUNGS[1], contender)]
    winner = max(aucs, key=aucs.get)
    out = [(n, a, n == winner, margin if n == "sequence" else None) for n, a in aucs.items()]
    return df.sparkSession.createDataFrame(
        out, "rung string, roc_auc double, winner boolean, margin_over_temporal double"
    )

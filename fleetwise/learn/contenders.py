"""The two classifiers, built by name: an MLlib pipeline and boosted trees on histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetwise.learn import boosting as bo
from fleetwise.operators.grading import DegenerateSplit
from fleetwise.operators.projection import assert_no_leakage
from fleetwise.shared import scope
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec

# Defaults and the parameters a search may change.
LOGREG_DEFAULTS = {"C": 1.0, "max_iter": 1000, "tol": 1e-5}
LOGREG_TUNABLE = ("C",)
BOOSTED_DEFAULTS = {
    "n_estimators": 200,
    "learning_rate": 0.05,
    "num_leaves": 31,
    "min_child_samples": 20,
    "reg_lambda": 0.0,
}
BOOSTED_TUNABLE = tuple(BOOSTED_DEFAULTS)

WEIGHT = "_weight"


@dataclass(frozen=True)
class Profile:
    """What a fit needs to know of its rows: class sizes and present values per feature."""

    rows: int
    positives: int
    present: Mapping[str, int]

    @property
    def two_classes(self) -> bool:
        return 0 < self.positives < self.rows


def profile(df: DataFrame, features: Sequence[str], label: str) -> Profile:
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col(label).cast("int")).alias("_pos"),
        *[F.count(c).alias(c) for c in features],
    ).first()
    return Profile(row["_rows"], row["_pos"] or 0, {c: row[c] for c in features})


def balanced(label: str, p: Profile):
    """Class weights n / (2 n_class)."""
    pos, neg = p.rows / (2.0 * p.positives), p.rows / (2.0 * (p.rows - p.positives))
    return F.when(F.col(label) == 1, F.lit(pos)).otherwise(F.lit(neg))


def repeated(rows: DataFrame, label: str, p: Profile, seed: int) -> DataFrame:
    """Rows of the rarer class as often as makes the classes equal, for fits without weights.

    Each comes the whole number of times, and once more with the chance of the remainder, drawn by
    a seeded hash of the row.
    """
    rare = 1 if p.positives <= p.rows - p.positives else 0
    few = p.positives if rare else p.rows - p.positives
    whole, part = divmod((p.rows - few) / few, 1.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 20)) / float(1 << 20)
    times = F.lit(int(whole)) + (draw < part).cast("int")
    each = F.when(F.col(label) == rare, times).otherwise(1)
    return rows.withColumn("_turn", F.explode(F.array_repeat(F.lit(0), each))).drop("_turn")


@dataclass(frozen=True)
class Fitted:
    """A fitted contender. ``score`` adds the probability of the positive class."""

    name: str
    features: tuple[str, ...]
    model: PipelineModel
    present: tuple[str, ...]  # features with a value in the fit

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        keep = df.columns
        ready = _prepared(df, self.name, self.present)
        scored = self.model.transform(ready)
        return scored.select(*keep, vector_to_array("probability")[1].alias(out))

    def importance(self) -> list[tuple[str, float]]:
        """Features by absolute scaled coefficient, largest first."""
        weights = [abs(float(v)) for v in self.model.stages[-1].coefficients.toArray()]
        sums = {f: 0.0 for f in self.features} | dict(zip(self.present, weights, strict=True))
        return sorted(sums.items(), key=lambda kv: kv[1], reverse=True)


def _prepared(df: DataFrame, name: str, present: Sequence[str]) -> DataFrame:
    if name == "sequence":  # the features are arrays, laid end to end
        return df.select("*", array_to_vector(F.concat(*present)).alias("_features"))
    return df.select("*", *[F.col(c).cast("double").alias(f"_x_{c}") for c in present])


@dataclass(frozen=True)
class Contender:
    name: str
    params: Mapping[str, object]
    build: Callable[[Profile, list[str], str], Pipeline] | None = field(default=None, repr=False)

    def fit(
        self,
        df: DataFrame,
        features: Sequence[str],
        spec: TelemetrySpec = DEFAULT,
        *,
        label: str | None = None,
    ) -> Fitted:
        """Fit on all rows of ``df``, as they are laid out: MLlib sums over partitions of any kind."""
        label = label or spec.target
        assert_no_leakage(features, spec)
        p = profile(df, features, label)
        if not p.two_classes:
            raise DegenerateSplit("cannot fit on one class")
        present = tuple(c for c in features if p.present[c] > 0)
        rows = df.select(*features, F.col(label).cast("double").alias(label))
        if self.params.get("repeat_rare"):
            rows = repeated(rows, label, p, int(self.params["seed"]))
        rows = rows.withColumn(WEIGHT, balanced(label, p))
        ready = _prepared(rows, self.name, present).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = self.build(
                p,
                [f"_x_{c}" for c in present],
                label,
            ).fit(ready)
        finally:
            ready.unpersist()
        return Fitted(self.name, tuple(features), model, present)


def _checked(
    overrides: Mapping[str, object] | None, allowed: Sequence[str], defaults: Mapping, who: str
) -> dict:
    overrides = dict(overrides or {})
    unknown = [k for k in overrides if k not in allowed]
    if unknown:
        raise ValueError(f"{who}: unknown parameters {unknown}; may set {list(allowed)}")
    return {**defaults, **overrides}


class LogisticContender(Contender):
    """The one whose objective ``learn/logistic.py`` fits for several folds at once."""


def logreg_model(seed: int = SEED,overrides: Mapping[str, object] | None = None) -> Contender:
    """Median fill, standard scale, logistic regression with balanced classes."""
    params = _checked(overrides, LOGREG_TUNABLE, LOGREG_DEFAULTS, "logreg")

    def build(p: Profile, values: list[str], label: str) -> Pipeline:
        filled = [f"{c}_filled" for c in values]
        return Pipeline(
            stages=[
                Imputer(strategy="median", inputCols=values, outputCols=filled),
                VectorAssembler(inputCols=filled, outputCol="_raw"),
                StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
                LogisticRegression(
                    featuresCol="_scaled",
                    labelCol=label,
                    weightCol=WEIGHT,
                    regParam=1.0 / (float(params["C"]) * p.rows),  # balanced weights sum to rows
                    standardization=False,
                    maxIter=int(params["max_iter"]),
                    tol=float(params["tol"]),
                ),
            ]
        )

    return LogisticContender("logreg", {**params, "seed": seed}, build)


def stack_model(seed: int = SEED, *, c: float = 1.0, max_iter: int = 1000) -> Contender:
    """Logistic regression with balanced classes over scores as they are: no fill, no scaling."""
    params = {"C": c, "max_iter": max_iter}

    def build(p: Profile, values: list[str], label: str) -> Pipeline:
        return Pipeline(
            stages=[
                VectorAssembler(inputCols=values, outputCol="_raw"),
                LogisticRegression(
                    featuresCol="_raw",
                    labelCol=label,
                    weightCol=WEIGHT,
                    regParam=1.0 / (c * p.rows),
                    standardization=False,
                    maxIter=max_iter,
                ),
            ]
        )

    return Contender("logreg", {**params, "seed": seed}, build)


@dataclass(frozen=True)
class BoostedContender(Contender):
    """Trees on histograms; models for several folds come from one job."""

    def fit(self, df: DataFrame, features: Sequence[str], spec: TelemetrySpec = DEFAULT, *, label: str | None = None) -> bo.Boosted:
        return self._fitted(df, features, spec, label, None, [None])[None]

    def fit_folds(
        self, df: DataFrame, features: Sequence[str], spec: TelemetrySpec = DEFAULT, *, folds: Sequence[int], label: str | None = None
    ) -> dict[int, bo.Boosted]:
        """For every fold the model that did not see it; folds whose other rows hold one class have none. Bins are shared."""
        return self._fitted(df, features, spec, label, "fold", folds)

    def _fitted(self, df, features, spec, label, fold, holds) -> dict:
        label = label or spec.target
        assert_no_leakage(features, spec)
        with scope():
            data = bo.table(df, features, label, fold)
            fine = [h for h in holds if 0 < data.balance(h)[1] < data.balance(h)[0]]
            if None in holds and not fine:
                raise DegenerateSplit("cannot fit on one class")
            if not fine:
                return {}
            rows = bo.advance(bo.models(df.sparkSession, [(self.params, h) for h in fine]), data).collect()
            return {
                r["hold"]: bo.Boosted(self.name, tuple(features), data.bins, tuple(bo.from_bytes(r["trees"]))) for r in rows
            }


def boosted_model(seed: int = SEED, overrides: Mapping[str, object] | None = None) -> Contender:
    """Boosted trees with balanced classes; every split learns the side of missing values."""
    params = _checked(overrides, BOOSTED_TUNABLE, BOOSTED_DEFAULTS, "boosted")
    return BoostedContender("boosted", {**params, "seed": seed})


def sequence_model(
    seed: int = SEED,
    spec: TelemetrySpec = DEFAULT,
    *,
    hidden: int = 16,
    max_iter: int = 100,
    repeat_rare: bool = True,
) -> Contender:
    """A small perceptron over the window arrays, laid end to end.

    MLlib's perceptron knows no weights; ``repeat_rare`` balances the classes of the rows it is fitted on.
    """
    params = {"hidden": hidden, "max_iter": max_iter, "repeat_rare": repeat_rare}
    cells = 2 * len(spec.signals) * spec.window_rows

    def build(p: Profile, values: list[str], label: str) -> Pipeline:
        return Pipeline(
            stages=[
                MultilayerPerceptronClassifier(
                    featuresCol="_features",
                    labelCol=label,
                    layers=[cells, hidden, 2],
                    maxIter=max_iter,
                    seed=seed,
                ),
            ]
        )

    return Contender("sequence", {**params, "seed": seed}, build)


def convolution_model(seed: int = SEED, *, c: float = 1.0, max_iter: int = 100) -> Contender:
    """Standard scale and logistic regression with balanced classes over the arrays of ``convolved``."""
    params = {"C": c, "max_iter": max_iter}

    def build(p: Profile, values: list[str], label: str) -> Pipeline:
        return Pipeline(
            stages=[
                StandardScaler(withMean=True, withStd=True, inputCol="_features", outputCol="_scaled"),
                LogisticRegression(
                    featuresCol="_scaled",
                    labelCol=label,
                    weightCol=WEIGHT,
                    regParam=1.0 / (c * p.rows),
                    standardization=False,
                    maxIter=max_iter,
                ),
            ]
        )

    return Contender("sequence", {**params, "seed": seed}, build)


BUILDERS = {"logreg": logreg_model, "boosted": boosted_model}


def model_field(
    seed: int = SEED, tuned: Mapping[str, Mapping[str, object]] | None = None
) -> list[Contender]:
    """All contenders in fixed order, each with its own overrides."""
    tuned = tuned or {}
    unknown = sorted(set(tuned) - set(BUILDERS))
    if unknown:
        raise ValueError(f"unknown contenders {unknown}")
    return [build(seed, tuned.get(name)) for name, build in BUILDERS.items()]

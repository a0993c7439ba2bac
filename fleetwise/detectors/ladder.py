"""All detectors in fixed order, their grades, and the suspicion feature made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.detectors.joint import TREES, MultivariateDetector, ReconstructionDetector
from fleetwise.detectors.temporal import TemporalDetector
from fleetwise.functions.scalars import clip, total
from fleetwise.operators.grading import adaptive_verdict, ladder_grades
from fleetwise.operators.projection import assert_no_leakage, require_columns
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec

SUSPECT = "signal_suspect"


class DetectorLadder(Estimator):
    """Fits every rung on the signals of one frame; ``transform`` adds one score per rung."""

    def __init__(
        self,
        spec: TelemetrySpec = DEFAULT,
        *,
        adaptive: bool = True,
        trees: int = TREES,
        seed: int = SEED,
    ):
        super().__init__()
        self.spec = spec
        self.rungs: list[Estimator] = [
            MultivariateDetector(spec, trees=trees, seed=seed),
            TemporalDetector(spec),
        ]
        if adaptive:
            self.rungs.append(ReconstructionDetector(spec))

    def _fit(self, dataset: DataFrame) -> "DetectorLadderModel":
        require_columns(dataset, [*self.spec.key, *self.spec.signals], "detectors")
        seen = dataset.select(*self.spec.key, *self.spec.signals)
        return DetectorLadderModel(self.spec, [r.fit(seen) for r in self.rungs])


class DetectorLadderModel(Model):
    def __init__(self, spec: TelemetrySpec, rungs: Sequence[Model]):
        super().__init__()
        self.spec, self.rungs = spec, list(rungs)

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rungs]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        # the windowed rung first: its shuffle then carries no scores of the others
        for rung in sorted(self.rungs, key=lambda r: r.name != "temporal"):
            out = rung.transform(out)
        return out.select(*dataset.columns, *self.names)


def score_ladder(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    model: DetectorLadderModel | None = None,
    trees: int = TREES,
    seed: int = SEED,
) -> DataFrame:
    """Grades per detector. Labels are read here only, never by a detector."""
    require_columns(df, [spec.outlier, spec.family], "score_ladder")
    model = model or DetectorLadder(spec, trees=trees, seed=seed).fit(df)
    wide = model.transform(df.select(*spec.key, *spec.signals, spec.outlier, spec.family))
    long = wide.unpivot([spec.outlier, spec.family], model.names, "detector", "score")
    return ladder_grades(long, spec=spec)


def ladder_verdict(grades: DataFrame) -> DataFrame:
    return adaptive_verdict(grades, ReconstructionDetector.name)


class SuspectFeature(Estimator):
    """Mean of the rungs as a feature. Fit it on train units only."""

    def __init__(
        self,
        spec: TelemetrySpec = DEFAULT,
        *,
        adaptive: bool = False,
        trees: int = TREES,
        seed: int = SEED,
    ):
        super().__init__()
        self.spec = spec
        self.ladder = DetectorLadder(spec, adaptive=adaptive, trees=trees, seed=seed)

    def _fit(self, dataset: DataFrame) -> "SuspectModel":
        return SuspectModel(self.spec, self.ladder.fit(dataset))


class SuspectModel(Model):
    def __init__(self, spec: TelemetrySpec, ladder: DetectorLadderModel):
        super().__init__()
        self.spec, self.ladder = spec, ladder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.ladder.transform(dataset)
        mean = total([F.col(n) for n in self.ladder.names]) / F.lit(float(len(self.ladder.names)))
        assert_no_leakage([*self.spec.signals, SUSPECT], self.spec)
        return scored.select(*dataset.columns, clip(mean).alias(SUSPECT))

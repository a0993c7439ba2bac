"""Plans around a fitted scorer: files, stored runs, quality of batches, search before training."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwise.detectors.joint import TREES
from fleetwise.detectors.ladder import SUSPECT, SuspectFeature, SuspectModel
from fleetwise.learn.contenders import BUILDERS
from fleetwise.learn.training import Comparison, param_search, prepare, side, train_compare
from fleetwise.operators.aggregates import data_quality_check, suspect_rate
from fleetwise.operators.grading import batch_summary
from fleetwise.operators.headers import suggest_mapping
from fleetwise.operators.projection import assert_scorable, coerce_numeric, resolve_mapping
from fleetwise.operators.rollup import unit_rollup
from fleetwise.shared import scope
from fleetwise.sources.readings import read_batch
from fleetwise.sources.runs import RunStore
from fleetwise.spec import DEFAULT, FOLDS, HIGH_RISK, SEED, SUSPECT_FLAG, SUSPECT_SPIKE, TelemetrySpec

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FileScore:
    mapping: dict[str, str | None]
    scored: DataFrame
    summary: DataFrame


def score_file(
    spark: SparkSession,
    path: str,
    scorer: Scorer,
    score: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    wanted: Mapping[str, str | None] | None = None,
    threshold: float = HIGH_RISK,
) -> FileScore:
    """Read a user's batch, map its headers, check it, score it and sum it up.

    ``wanted`` overrides the proposed mapping; headers that the batch lacks are dropped from it.
    """
    batch = read_batch(spark, path)
    proposal = suggest_mapping(spark, batch.columns, spec) if wanted is None else wanted
    mapping = resolve_mapping(batch.columns, proposal, spec)
    typed = coerce_numeric(batch, mapping, spec)
    assert_scorable(typed, mapping, spec)
    scored = scorer(typed)
    return FileScore(mapping, scored, batch_summary(scored, score, threshold))


def run_report(
    store: RunStore, run_id: str, model_version: str, scorer: Scorer, score: str
) -> tuple[DataFrame, bool]:
    """The roll-up of a stored run under a model version, and whether it was stored already."""
    known = store.load_report(run_id, model_version)
    if not known.isEmpty():
        return known, True
    rollup = unit_rollup(scorer(store.readings(run_id)), score, store.spec)
    store.save_report(run_id, model_version, rollup)
    return store.load_report(run_id, model_version), False


def search_and_train(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    trials: int = 40,
    folds: int = FOLDS,
    seed: int = SEED,
    trees: int = TREES,
    names: tuple[str, ...] = tuple(BUILDERS),
) -> tuple[dict[str, dict], Comparison]:
    """Search the parameters of all contenders on the clean train frame, then train with the best."""
    with scope():
        frame, features = prepare(df, spec, seed=seed, clean=True, trees=trees)
        train = side(frame, "train")
        tuned = {
            n: param_search(n, train, features, spec, trials=trials, folds=folds, seed=seed)[0]["params"]
            for n in names
        }
    return tuned, train_compare(df, spec, seed=seed, tuned=tuned, clean=True, trees=trees)


@dataclass(frozen=True)
class QualityWatcher:
    """The fitted suspicion with the suspect rate of the readings it was fitted on."""

    model: SuspectModel
    baseline: float
    flag: float

    def check(self, batch: DataFrame, *, spike: float = SUSPECT_SPIKE, strict: bool = False) -> DataFrame:
        scored = self.model.transform(batch)
        return data_quality_check(
            scored, SUSPECT, self.baseline, spike=spike, flag=self.flag, strict=strict
        )


def quality_watcher(
    reference: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    flag: float = SUSPECT_FLAG,
    trees: int = TREES,
    seed: int = SEED,
) -> QualityWatcher:
    model = SuspectFeature(spec, trees=trees, seed=seed).fit(reference)
    rate = suspect_rate(model.transform(reference), SUSPECT, flag).first()["suspect_rate"]
    return QualityWatcher(model, rate, flag)

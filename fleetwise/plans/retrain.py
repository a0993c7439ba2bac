"""Drift check, retraining on the drifted batch, and the promotion gate, as one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.learn.training import Comparison, train_compare
from fleetwise.operators.drift import drift_decision, feature_drift
from fleetwise.plans.promotion import gate
from fleetwise.shared import stored
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec


@dataclass(frozen=True)
class RetrainResult:
    features: DataFrame  # drift evidence per signal
    decision: DataFrame  # one row: drifted or not
    comparison: Comparison | None  # None when nothing drifted
    promotion: DataFrame | None


def drift_retrain_job(
    reference: DataFrame,
    current: DataFrame,
    live: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    name: str = "failure_model",
    min_delta: float = 0.0,
    seed: int = SEED,
    tuned: Mapping[str, Mapping[str, object]] | None = None,
    clean: bool | None = None,
) -> RetrainResult:
    """Train on the current batch when it drifted, and let the result through the gate.

    ``live`` holds (name, live_version, live_auc); it is empty before the first promotion.
    """
    features = stored(feature_drift(reference, current, spec), "drift")
    decision = drift_decision(features, spec)
    if not decision.first()["drifted"]:
        return RetrainResult(features, decision, None, None)
    comparison = train_compare(current, spec, seed=seed, tuned=tuned, clean=clean)
    newest = live.agg(F.coalesce(F.max("live_version"), F.lit(0))).first()[0]
    won = comparison.scores.filter(F.col("name") == comparison.winner)
    request = won.select(
        F.lit(name).alias("name"),
        F.lit(newest + 1).cast("bigint").alias("seq"),
        F.lit(newest + 1).cast("bigint").alias("version"),
        "roc_auc",
        F.lit(False).alias("forced"),
    )
    return RetrainResult(features, decision, comparison, gate(request, live, min_delta))

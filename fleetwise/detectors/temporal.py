"""Stuck sensors and slow creeps, per unit."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from fleetwise.operators.aggregates import shape_rates
from fleetwise.operators.projection import require_columns
from fleetwise.operators.windows import any_flag, shape_flags
from fleetwise.spec import DEFAULT, TelemetrySpec


class TemporalDetector(Estimator):
    """Learns from the signals alone which of them may show a stuck value or a creep."""

    name = "temporal"

    def __init__(self, spec: TelemetrySpec = DEFAULT):
        super().__init__()
        self.spec = spec

    def _fit(self, dataset: DataFrame) -> "TemporalModel":
        rates = shape_rates(dataset, self.spec).collect()  # one row per signal
        return TemporalModel(
            self.spec,
            [r["signal"] for r in rates if r["continuous"]],
            [r["signal"] for r in rates if r["driftable"]],
        )


class TemporalModel(Model):
    name = "temporal"

    def __init__(self, spec: TelemetrySpec, continuous: list[str], driftable: list[str]):
        super().__init__()
        self.spec, self.continuous, self.driftable = spec, continuous, driftable

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add the score: 1 on a row in a stuck block or at the end of a creep, else 0."""
        require_columns(dataset, self.spec.key, "temporal detector")
        keep = [c for c in dataset.columns if c not in self.spec.key]
        flags = shape_flags(dataset, self.continuous, self.driftable, self.spec, keep=keep)
        used = [f"{s}__stuck" for s in self.continuous] + [f"{s}__monotone" for s in self.driftable]
        return flags.select(*dataset.columns, any_flag(used).alias(self.name))

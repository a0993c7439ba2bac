"""Reconstruction that follows curves: principal directions among random Fourier features.

A row is mapped to cosines of random projections, which stand for a Gaussian kernel (Rahimi and Recht
2007). The directions that hold variance there describe where rows usually lie, bent or not; what they
leave of a row is its error (Hoffmann 2007). Directions are not counted out by a cut: each gives a row back
by the share variance / (variance + ridge), so that the error changes smoothly with the table. A linear
reconstruction sees the correlations only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.operators.aggregates import MinMax, fit_minmax, signal_moments, standardised
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec

FEATURES = 256
WIDTH = 3.0  # kernel width, in root mean square distances of a row from the centre
RIDGE = 1e-5  # variance at which a direction gives back half; the features have length 1


@dataclass(frozen=True)
class Fourier:
    """Seeded random cosines; the same for the same seed, signals and features."""

    weights: np.ndarray  # (signals, features)
    shifts: np.ndarray

    @staticmethod
    def draw(signals: int, features: int, width: float, seed: int) -> "Fourier":
        rng = np.random.default_rng(seed)
        weights = rng.normal(size=(signals, features)) / (width * np.sqrt(signals))
        return Fourier(weights, rng.uniform(0.0, 2 * np.pi, features))

    def of(self, z: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.shifts)) * np.cos(z @ self.weights + self.shifts)


def feature_moments(z: DataFrame, fourier: Fourier) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of the features over all rows.

    A task sums its rows into one matrix and hands on a row per line of it; the lines of all tasks are
    added by Spark, so the driver sees features x features numbers however large the table is.
    """
    width = len(fourier.shifts)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((width + 1, width + 1))
        for pdf in batches:
            phi = fourier.of(pdf.to_numpy("float64"))
            phi = np.column_stack([phi, np.ones(len(phi))])  # the last line: sums and the row count
            held += phi.T @ phi
        if held[width, width]:
            yield pd.DataFrame({"line": np.arange(width + 1), "cells": list(held)})

    lines = z.mapInPandas(sums, "line int, cells array<double>")
    added = lines.groupBy("line").agg(*[F.sum(F.col("cells")[i]).alias(f"c{i}") for i in range(width + 1)])
    got = added.toPandas().sort_values("line").drop(columns="line").to_numpy("float64")
    if not len(got):
        raise ValueError("kernel reconstruction: no rows to fit on")
    n = got[width, width]
    mean = got[width, :width] / n
    return int(n), mean, got[:width, :width] / n - np.outer(mean, mean)


class KernelReconstructionDetector(Estimator):
    """Rows that lie off the curved surface on which most rows lie.

    A missing signal sits at the centre of its own. All rows are read for the fit, once for the moments
    of the signals, once for those of the features and once for the range of errors.
    """

    name = "kernel_reconstruction"

    def __init__(
        self,
        spec: TelemetrySpec = DEFAULT,
        *,
        features: int = FEATURES,
        width: float = WIDTH,
        ridge: float = RIDGE,
        seed: int = SEED,
    ):
        super().__init__()
        self.spec, self.features, self.width = spec, features, width
        self.ridge, self.seed = ridge, seed

    def _fit(self, dataset: DataFrame) -> "KernelReconstructionModel":
        spec = self.spec
        moments = signal_moments(dataset, spec)
        fourier = Fourier.draw(len(spec.signals), self.features, self.width, self.seed)
        z = dataset.select(*[standardised(moments, s).alias(f"_z_{s}") for s in spec.signals])
        _, mean, cov = feature_moments(z, fourier)
        values, vectors = np.linalg.eigh(cov)
        left = vectors * np.sqrt(self.ridge / (values.clip(min=0.0) + self.ridge))
        model = KernelReconstructionModel(spec, moments, fourier, mean, left, None)
        scale = fit_minmax(model.errors(dataset, self.name).select(self.name), [self.name])[self.name]
        return KernelReconstructionModel(spec, moments, fourier, mean, left, scale)


class KernelReconstructionModel(Model):
    name = "kernel_reconstruction"

    def __init__(self, spec, moments, fourier: Fourier, mean, left, scale: MinMax | None):
        super().__init__()
        self.spec, self.moments, self.fourier = spec, moments, fourier
        self.mean, self.left, self.scale = mean, left, scale

    def errors(self, dataset: DataFrame, out: str) -> DataFrame:
        """Squared length of what the directions leave of a row."""
        fourier, mean, left = self.fourier, self.mean, self.left

        @F.pandas_udf("double")
        def error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                off = fourier.of(np.column_stack([c.to_numpy("float64") for c in columns])) - mean
                yield pd.Series(np.square(off @ left).sum(1))

        return dataset.withColumn(out, error(*[standardised(self.moments, s) for s in self.spec.signals]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.errors(dataset, self.name).withColumn(self.name, self.scale.of(F.col(self.name)))

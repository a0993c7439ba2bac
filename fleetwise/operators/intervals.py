"""How sure an AUC is: a bootstrap over whole units, all replicates in one pass.

Rows of one unit are alike, so units are drawn, not rows. A unit counts Poisson(1) times in a replicate
(Chamandy et al. 2012), by a hash of the unit and the replicate: nothing is copied, no draw is stored, and
the same unit weighs the same in every score and slice, so that differences are paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwise.operators.grading import graded, horizon_bands
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec

REPLICATES = 200
LEVEL = 0.95
_CELLS = 4_000_000  # weights that a task holds at once
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_weights(units: np.ndarray, replicates: np.ndarray, seed: int = SEED) -> np.ndarray:
    """How often each unit (by its 64-bit hash) counts in each replicate; once in replicate 0."""
    salt = _mixed(np.asarray(replicates, np.uint64) + np.uint64(seed << 32) + np.uint64(1))
    drawn = _mixed(np.asarray(units).astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :])
    out = np.searchsorted(_POISSON, (drawn >> np.uint64(11)) * 2.0**-53, side="right").astype(np.int64)
    out[:, np.asarray(replicates) == 0] = 1
    return out


def auc_replicates(
    df: DataFrame,
    score: str,
    label: str,
    unit: str,
    slices: Mapping[str, Column] | None = None,
    *,
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """(slice, replicate, n_positive, roc_auc) for each slice's positives against all negatives.

    Replicate 0 is the AUC of the rows as they are. Rows are counted per (score, unit) and range
    partitioned on both; a task turns its range into three segments per replicate (its lowest score,
    its highest, and what lies between), because scores at its borders may go on in the next range.
    Only segments are put in order afterwards, so a score that a third of the rows have is many tasks.
    A NULL score ranks below all numbers, a row without a label counts nowhere, NULL units are one unit.
    """
    slices = {"all": F.lit(True)} if slices is None else dict(slices)
    names, k = list(slices), len(slices)
    positive = F.col(label).cast("int") == 1
    of_pos = [f"pos_{i}" for i in range(k)]
    hits = [F.count_if(positive & F.coalesce(slices[s], F.lit(False))).alias(c) for s, c in zip(names, of_pos)]
    counts = (
        graded(df, score)
        .groupBy(
            F.coalesce(F.col(score).cast("double"), F.lit(-math.inf)).alias("score"), F.xxhash64(unit).alias("unit")
        )
        .agg(F.count_if(~positive).alias("neg"), *hits)
    )
    laid = counts.repartitionByRange("score", "unit").sortWithinPartitions("score", "unit")
    wins = [f"wins_{i}" for i in range(k)]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        at = pdf["score"].to_numpy()
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = len(begin) - 1
        units, counted = pdf["unit"].to_numpy(), pdf[["neg", *of_pos]].to_numpy("int64")
        step = max(1, _CELLS // len(pdf))
        for start in range(0, replicates + 1, step):
            drawn = np.arange(start, min(start + step, replicates + 1))
            weights = unit_weights(units, drawn, seed)
            # distinct scores x replicates, for negatives and for every slice
            sums = [np.add.reduceat(weights * c[:, None], begin, axis=0) for c in counted.T]
            for edge in sorted({0, last}):
                row = {"score": at[begin[edge]], "edge": True, "replicate": drawn, "neg": sums[0][edge]}
                row |= {c: s[edge] for c, s in zip(of_pos, sums[1:])} | dict.fromkeys(wins, 0.0)
                yield pd.DataFrame(row)
            if last >= 2:
                inner = [s[1:last] for s in sums]
                below = np.cumsum(inner[0], axis=0) - inner[0] / 2
                row = {"score": at[begin[1]], "edge": False, "replicate": drawn, "neg": inner[0].sum(0)}
                row |= {c: s.sum(0) for c, s in zip(of_pos, inner[1:])}
                row |= {c: (s * below).sum(0) for c, s in zip(wins, inner[1:])}
                yield pd.DataFrame(row)

    ddl = "score double, edge boolean, replicate int, neg bigint, "
    ddl += ", ".join([f"{c} bigint" for c in of_pos] + [f"{c} double" for c in wins])
    # the parts of one score that several ranges hold are one segment
    parts = (
        laid.mapInPandas(segments, ddl)
        .groupBy("replicate", "score", "edge")
        .agg(*[F.sum(c).alias(c) for c in ("neg", *of_pos, *wins)])
    )
    lower = Window.partitionBy("replicate").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    ties = F.when(F.col("edge"), F.col("neg") / F.lit(2.0)).otherwise(F.lit(0.0))
    won = [F.sum(F.col(w) + F.col(p) * (F.col("_below") + ties)).alias(w) for p, w in zip(of_pos, wins)]
    sums = placed.groupBy("replicate").agg(F.sum("neg").alias("neg"), *[F.sum(p).alias(p) for p in of_pos], *won)
    entries = [
        F.struct(
            F.lit(s).alias("slice"),
            F.col(p).alias("n_positive"),
            F.when((F.col(p) > 0) & (F.col("neg") > 0), F.col(w) / (F.col(p).cast("double") * F.col("neg"))).alias(
                "roc_auc"
            ),
        )
        for s, p, w in zip(names, of_pos, wins)
    ]
    return sums.select("replicate", F.inline(F.array(*entries))).select("slice", "replicate", "n_positive", "roc_auc")


def _interval(value: Column, level: float) -> list[Column]:
    drawn = F.when(F.col("replicate") > 0, value)
    return [
        F.max(F.when(F.col("replicate") == 0, value)).alias("value"),
        F.percentile(drawn, (1 - level) / 2).alias("low"),
        F.percentile(drawn, (1 + level) / 2).alias("high"),
        F.count(drawn).alias("n_replicates"),
    ]


def auc_intervals(
    df: DataFrame,
    score: str,
    label: str,
    unit: str,
    slices: Mapping[str, Column] | None = None,
    *,
    replicates: int = REPLICATES,
    level: float = LEVEL,
    seed: int = SEED,
) -> DataFrame:
    """Per slice: positives, AUC, and the interval that holds the middle ``level`` of the replicates.

    A replicate that drew one class only has no AUC; ``n_replicates`` counts those that have one.
    """
    drawn = auc_replicates(df, score, label, unit, slices, replicates=replicates, seed=seed)
    n = F.max(F.when(F.col("replicate") == 0, F.col("n_positive"))).alias("n_positive")
    out = drawn.groupBy("slice").agg(n, *_interval(F.col("roc_auc"), level))
    return out.withColumnRenamed("value", "roc_auc")


def auc_intervals_by_horizon(
    df: DataFrame, score: str, spec: TelemetrySpec = DEFAULT, ttf: str = "time_to_failure_h", **settings
) -> DataFrame:
    """Bands close to the failure hold few units: their intervals say how few."""
    slices = {n: (F.col(ttf) >= low) & (F.col(ttf) < high) for n, (low, high) in horizon_bands().items()}
    return auc_intervals(df, score, spec.target, spec.unit, slices, **settings)


def auc_difference(
    df: DataFrame,
    score: str,
    other: str,
    label: str,
    unit: str,
    slices: Mapping[str, Column] | None = None,
    *,
    replicates: int = REPLICATES,
    level: float = LEVEL,
    seed: int = SEED,
) -> DataFrame:
    """Per slice: AUC of ``score`` less that of ``other``, with the interval of the paired replicates."""
    a, b = (
        auc_replicates(df, c, label, unit, slices, replicates=replicates, seed=seed).withColumnRenamed("roc_auc", n)
        for c, n in ((score, "_a"), (other, "_b"))
    )
    both = a.join(b.drop("n_positive"), ["slice", "replicate"])
    out = both.groupBy("slice").agg(*_interval(F.col("_a") - F.col("_b"), level))
    return out.withColumnRenamed("value", "difference")

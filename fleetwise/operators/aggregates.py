"""Aggregates over signals and scores: medians, moments, scaling, rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.functions.scalars import clip
from fleetwise.operators.ordered import quantiles_within
from fleetwise.operators.windows import shape_flags
from fleetwise.spec import (
    DEFAULT,
    MONOTONE_MAX,
    REPEAT_MAX,
    SUSPECT_FLAG,
    SUSPECT_SPIKE,
    TelemetrySpec,
)

_INF = float("inf")
_ROUGH = 2000  # accuracy of the approximate pass of an exact quantile


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float) -> dict[str, float | None]:
    """Exact interpolated quantile of each column, as ``{column: value}``.

    An approximate pass brackets every quantile. Values outside their bracket are counted as one
    value per side before the shuffle, so only the narrow bracket is sorted. Should a bracket miss,
    the column is sorted as a whole.
    """
    reach = 5.0 / _ROUGH  # five times the rank error of the approximate pass
    ends = [max(0.0, q - reach), min(1.0, q + reach)]
    rough = df.agg(*[F.percentile_approx(c, ends, _ROUGH).alias(c) for c in columns]).first()
    brackets = {c: tuple(rough[c]) if rough[c] is not None else None for c in columns}
    found: dict[str, float | None] = {c: None for c in columns}
    todo = {c: b for c, b in brackets.items() if b is not None}
    if not todo:
        return found
    found.update(_bracketed(df, todo, q))
    missed = {c: (-_INF, _INF) for c in todo if found[c] in (None, _INF, -_INF)}
    missed.update({c: (-_INF, _INF) for c in todo if found[c] != found[c]})
    if missed:
        found.update(_bracketed(df, missed, q))
    return found


def _bracketed(df: DataFrame, brackets: dict[str, tuple[float, float]], q: float) -> dict:
    clipped = [
        F.when(F.col(c) < low, F.lit(-_INF))
        .when(F.col(c) > high, F.lit(_INF))
        .otherwise(F.col(c))
        .cast("double")
        .alias(c)
        for c, (low, high) in brackets.items()
    ]
    counts = (
        df.select(*clipped)
        .unpivot([], list(brackets), "signal", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("signal", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = quantiles_within(counts, ["signal"], "value", q).collect()
    return {r["signal"]: r["quantile"] for r in rows}


def signal_medians(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> dict[str, float | None]:
    return exact_quantiles(df, spec.signals, 0.5)


def impute(df: DataFrame, fill: dict[str, float | None]) -> DataFrame:
    """Replace NULL signals by fitted values; a signal without one becomes 0."""
    return df.withColumns(
        {s: F.coalesce(F.col(s), F.lit(0.0 if v is None else float(v))) for s, v in fill.items()}
    )


def moments_table(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Per signal: count, mean, sample and population deviation, in one pass."""
    aggs = []
    for s in spec.signals:
        aggs += [
            F.count(s).alias(f"{s}_n"),
            F.avg(s).alias(f"{s}_mean"),
            F.stddev_samp(s).alias(f"{s}_samp"),
            F.stddev_pop(s).alias(f"{s}_pop"),
        ]
    entries = [
        F.struct(
            F.lit(s).alias("signal"),
            F.col(f"{s}_n").alias("n"),
            F.col(f"{s}_mean").alias("mean"),
            F.col(f"{s}_samp").alias("std_samp"),
            F.col(f"{s}_pop").alias("std_pop"),
        )
        for s in spec.signals
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


@dataclass(frozen=True)
class Moments:
    """Fitted centre and scale per signal; a zero or absent deviation scales by 1."""

    centre: dict[str, float]
    scale: dict[str, float]


def signal_moments(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, *, sample: bool = True
) -> Moments:
    rows = {r["signal"]: r for r in moments_table(df, spec).collect()}  # one row per signal
    name = "std_samp" if sample else "std_pop"
    return Moments(
        {s: rows[s]["mean"] or 0.0 for s in spec.signals},
        {s: rows[s][name] or 1.0 for s in spec.signals},
    )


def standardised(moments: Moments, signal: str) -> Column:
    """A missing signal sits at the centre."""
    z = (F.col(signal) - F.lit(moments.centre[signal])) / F.lit(moments.scale[signal])
    return F.coalesce(z, F.lit(0.0))


@dataclass(frozen=True)
class MinMax:
    low: float | None
    high: float | None

    def of(self, c: Column) -> Column:
        """Scale to [0, 1]; NULL, and everything when the fit saw one value only, becomes 0."""
        if self.low is None or self.high is None or self.high <= self.low:
            return F.lit(0.0)
        unit = (c - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.coalesce(clip(unit), F.lit(0.0))


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, MinMax]:
    usable = {
        c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(_INF)), F.col(c)) for c in columns
    }
    row = df.agg(
        *[F.min(u).alias(f"lo_{c}") for c, u in usable.items()],
        *[F.max(u).alias(f"hi_{c}") for c, u in usable.items()],
    ).first()
    return {c: MinMax(row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def minmax01(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale one score over the batch it belongs to."""
    return df.withColumn(out, fit_minmax(df, [column])[column].of(F.col(column)))


def shape_rates(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Per signal: share of present rows that repeat the one before, share of rows in a creep.

    ``continuous`` and ``driftable`` say which signals the temporal detector may use; a signal
    that is never present is neither.
    """
    flags = shape_flags(df, spec.signals, spec.signals, spec, keep=spec.signals)
    aggs = []
    for s in spec.signals:
        aggs += [
            F.count(s).alias(f"{s}_n"),
            F.avg(F.when(F.col(s).isNotNull(), F.col(f"{s}__repeat"))).alias(f"{s}_repeat"),
            F.avg(f"{s}__monotone").alias(f"{s}_mono"),
        ]
    entries = [
        F.struct(
            F.lit(s).alias("signal"),
            F.col(f"{s}_repeat").alias("repeat_rate"),
            F.col(f"{s}_mono").alias("monotone_rate"),
            ((F.col(f"{s}_n") > 0) & (F.col(f"{s}_repeat") < REPEAT_MAX)).alias("continuous"),
            ((F.col(f"{s}_n") > 0) & (F.col(f"{s}_mono") < MONOTONE_MAX)).alias("driftable"),
        )
        for s in spec.signals
    ]
    return flags.agg(*aggs).select(F.inline(F.array(*entries)))


def suspect_rate(df: DataFrame, score: str, flag: float = SUSPECT_FLAG) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col(score) >= flag).cast("double")).alias("suspect_rate"),
    )


class DataQualitySpike(RuntimeError):
    """A batch holds far more suspect rows than its reference."""


def quality_verdict(
    rates: DataFrame, baseline: float, spike: float = SUSPECT_SPIKE
) -> DataFrame:
    """Add the baseline and whether the rate exceeds ``spike`` times it."""
    return rates.select(
        "*",
        F.lit(float(baseline)).alias("baseline_rate"),
        F.lit(float(spike)).alias("spike_factor"),
        (F.col("suspect_rate") > F.lit(baseline * spike)).alias("tripped"),
    )


def data_quality_check(
    batch: DataFrame,
    score: str,
    baseline: float,
    *,
    spike: float = SUSPECT_SPIKE,
    flag: float = SUSPECT_FLAG,
    strict: bool = False,
) -> DataFrame:
    out = quality_verdict(suspect_rate(batch, score, flag), baseline, spike)
    if strict:
        row = out.first()
        if row["tripped"]:
            raise DataQualitySpike(
                f"suspect rate {row['suspect_rate']:.4f} over {spike:g} x {baseline:.4f}"
            )
    return out

"""Projections, guards and row filters on the readings table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.functions.scalars import to_number
from fleetwise.operators.blocks import POSITION, numbered
from fleetwise.spec import DEFAULT, SIGNAL_BOUNDS, TelemetrySpec

LEAK_FEATURES = ("failure_mode", "time_to_failure_h")  # fixed values: never honest inputs


class Leakage(ValueError):
    """A label-side column was offered as a feature."""


class Unscorable(ValueError):
    """A batch that no model can score."""


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in expected if c not in present]


def require_columns(df: DataFrame, expected: Sequence[str], who: str) -> None:
    absent = missing_columns(df, expected)
    if absent:
        raise KeyError(f"{who}: missing columns {absent}")


def assert_no_leakage(columns: Iterable[str], spec: TelemetrySpec = DEFAULT) -> None:
    leaked = sorted(set(columns) & set(spec.label_side))
    if leaked:
        raise Leakage(f"label-side columns among the features: {leaked}")


def assert_honest(columns: Iterable[str], spec: TelemetrySpec = DEFAULT) -> None:
    """The leakage guard plus the two columns only the diagnostic bound may see."""
    columns = list(columns)
    assert_no_leakage(columns, spec)
    leaked = [c for c in columns if c in LEAK_FEATURES or c.startswith("failure_mode__")]
    if leaked:
        raise Leakage(f"diagnostic columns among the features: {leaked}")


def select_features(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, keep: Sequence[str] = ()
) -> DataFrame:
    """Project onto the signals; NULLs stay NULL. ``keep`` adds key columns in front."""
    require_columns(df, spec.signals, "select_features")
    assert_no_leakage(keep, spec)
    return df.select(*keep, *spec.signals)


def coerce_numeric(
    df: DataFrame,
    mapping: Mapping[str, str | None],
    spec: TelemetrySpec = DEFAULT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fill the signal slots from mapped source columns; an unmapped signal is all NULL."""
    source = {s: mapping.get(s) for s in spec.signals}
    present = set(df.columns)
    slots = [
        (to_number(c) if c in present else F.lit(None).cast("double")).alias(s)
        for s, c in source.items()
    ]
    out = df.select(*keep, *slots)
    assert_no_leakage(spec.signals, spec)
    return out


def resolve_mapping(
    headers: Sequence[str], wanted: Mapping[str, str | None], spec: TelemetrySpec = DEFAULT
) -> dict[str, str | None]:
    known = set(headers)
    return {s: wanted.get(s) if wanted.get(s) in known else None for s in spec.signals}


def mapping_table(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """The resolved mapping with the share of readable values behind every signal."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            (F.count(to_number(h)) if h else F.lit(0).cast("bigint")).alias(s)
            for s, h in mapping.items()
        ],
    )
    entries = [
        F.struct(
            F.lit(s).alias("signal"),
            F.lit(h).cast("string").alias("header"),
            F.lit(h is not None).alias("mapped"),
            F.col("n_rows"),
            F.col(s).alias("n_values"),
        )
        for s, h in mapping.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


def assert_scorable(
    df: DataFrame, mapping: Mapping[str, str | None], spec: TelemetrySpec = DEFAULT
) -> None:
    mapped = [s for s, h in mapping.items() if h is not None]
    if not mapped:
        raise Unscorable("no signal is mapped to a column")
    seen = df.agg(*[F.count(s).alias(s) for s in mapped]).first()
    if not any(seen):
        raise Unscorable("the mapped columns hold no numbers")


def downsample(df: DataFrame, every: int, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Every k-th row of each unit, counted from the unit's first row."""
    return numbered(df, spec).filter(F.col(POSITION) % every == 0).drop(POSITION)


def keep_units(df: DataFrame, units: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    return df.join(units.select(spec.unit), spec.unit, "left_semi")


def scenario_shift(df: DataFrame, shifts: Mapping[str, float]) -> DataFrame:
    """A shifted copy of a batch, as a drift stimulus."""
    return df.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in shifts.items()})


def _long(columns: Sequence[str], **values: Mapping[str, Column]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("signal"), *[v[c].alias(name) for name, v in values.items()]
                )
                for c in columns
            ]
        )
    )


def range_check(
    df: DataFrame,
    bounds: Mapping[str, tuple[float, float]] = SIGNAL_BOUNDS,
    spec: TelemetrySpec = DEFAULT,
) -> DataFrame:
    """Per signal: rows below, above and inside its plausible range."""
    aggs = []
    for s in spec.signals:
        low, high = bounds[s]
        aggs += [
            F.count_if(F.col(s) < low).alias(f"{s}_below"),
            F.count_if(F.col(s) > high).alias(f"{s}_above"),
            F.count_if(F.col(s).between(low, high)).alias(f"{s}_inside"),
        ]
    pick = lambda end: {s: F.col(f"{s}_{end}") for s in spec.signals}
    return df.agg(*aggs).select(
        _long(spec.signals, n_below=pick("below"), n_above=pick("above"), n_inside=pick("inside"))
    )


def outside_range(
    bounds: Mapping[str, tuple[float, float]] = SIGNAL_BOUNDS, spec: TelemetrySpec = DEFAULT
) -> Column:
    """How many signals of a row lie outside their plausible range."""
    return sum(
        (
            F.when(~F.col(s).between(*bounds[s]), 1).otherwise(0) for s in spec.signals
        ),
        start=F.lit(0),
    )


def missing_profile(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Per signal: rows, NULLs, and whether the batch provides the signal at all."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(s).alias(s) for s in spec.signals]
    )
    return counts.select(
        _long(
            spec.signals,
            n_rows={s: F.col("_rows") for s in spec.signals},
            n_null={s: F.col("_rows") - F.col(s) for s in spec.signals},
            provided={s: F.col(s) > 0 for s in spec.signals},
        )
    )


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]



"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TEXT_LIMIT = 500  # fixed value: stored error text is cut here


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or(c: Column, fallback: float) -> Column:
    """NULL, NaN and infinities become ``fallback``."""
    usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(usable, c).otherwise(F.lit(float(fallback)))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_number(name: str) -> Column:
    """Text or number to double; anything unreadable (NaN too) becomes NULL."""
    return nan_to_null(F.expr(f"try_cast(`{name}` AS double)"))


def plain_name(c: Column) -> Column:
    """Lower case, letters and digits only, of any alphabet."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def signal_map(signals: Sequence[str]) -> Column:
    """All signals of a row as one map; a missing signal stays in the map with a NULL value."""
    return F.map_from_arrays(
        F.array(*[F.lit(s) for s in signals]), F.array(*[F.col(s).cast("double") for s in signals])
    )


def known_signals(c: Column, signals: Sequence[str]) -> Column:
    """Drop map keys that are no signal, and give every signal an entry."""
    kept = F.map_filter(c, lambda k, _: k.isin(list(signals)))
    return F.map_from_arrays(
        F.array(*[F.lit(s) for s in signals]),
        F.array(*[F.try_element_at(kept, F.lit(s)) for s in signals]),
    )


def signals_from_map(c: Column, signals: Sequence[str]) -> list[Column]:
    return [F.try_element_at(c, F.lit(s)).alias(s) for s in signals]


def map_to_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_to_map(c: Column) -> Column:
    return F.from_json(c, "map<string,double>")


def one_hot(name: str, values: Sequence[str]) -> list[Column]:
    return [
        F.when(F.col(name) == v, 1).otherwise(0).alias(f"{name}__{v}") for v in values
    ]


def short_error(c: Column) -> Column:
    return F.left(c, F.lit(ERROR_TEXT_LIMIT))


def utc(c: Column, zone: str = "UTC") -> Column:
    """A wall-clock time of ``zone`` as an instant; the session zone is UTC throughout."""
    return F.to_utc_timestamp(c, zone)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def highest(columns: Sequence[Column], empty: float = 0.0) -> Column:
    """``greatest`` that also takes one column or none."""
    if not columns:
        return F.lit(empty)
    return columns[0] if len(columns) == 1 else F.greatest(*columns)

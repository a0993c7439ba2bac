"""Shared pieces of the registered queries: input frames, a fixed row score, SQL helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwise.sources.stand_in import readings, readings_sql
from fleetwise.spec import SIGNALS

Query = Callable[[SparkSession, str], DataFrame]

# A fixed row score, valid in Spark SQL and in ANSI SQL. It has ties and reaches both ends.
SCORE = (
    "floor(least(1e0, greatest(0e0, (coolant_temp_c - 80e0) / 60e0"
    " + (400e0 - oil_pressure_kpa) / 400e0"
    " + coalesce((vibration_mms - 4e0) / 30e0, 0e0))) * 1000e0) / 1000e0"
)


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return register


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("score", F.expr(SCORE))


def on_readings(body: str, *ctes: str) -> str:
    """SQL over ``readings`` and ``scored``."""
    parts = [
        f"readings AS MATERIALIZED ({readings_sql()})",
        f"scored AS MATERIALIZED (SELECT *, {SCORE} AS score FROM readings)",
        *ctes,
    ]
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded_columns(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def rd(sql: str, digits: int = 6) -> str:
    """Rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round({sql}, {digits}) + 0e0)"


def each(template: str, signals=SIGNALS, joiner: str = ",\n") -> str:
    """The template once per signal, with ``$`` standing for its name."""
    return joiner.join(template.replace("$", s) for s in signals)


def union(template: str, signals=SIGNALS) -> str:
    return each(template, signals, "\nUNION ALL\n")


UNIT_TIME = "PARTITION BY unit_id ORDER BY t_index"
COLUMNS = ", ".join(SIGNALS)

"""The append-only prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.functions.scalars import known_signals, signal_map
from fleetwise.spec import DEFAULT, TelemetrySpec

LOG_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("failure_probability", T.DoubleType(), False),
        T.StructField("readings", T.MapType(T.StringType(), T.DoubleType()), False),
    ]
)


def log_rows(
    df: DataFrame,
    score: str,
    model_version: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    created_at: Column | None = None,
    readings: Column | None = None,
) -> DataFrame:
    """Scored rows in the log's form. Only known signals are kept of a given readings map."""
    values = signal_map(spec.signals) if readings is None else known_signals(readings, spec.signals)
    return df.select(
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(str(model_version)).alias("model_version"),
        F.col(score).cast("double").alias("failure_probability"),
        values.alias("readings"),
    )


def log_predictions(df: DataFrame, path: str, score: str, model_version: str, **options) -> None:
    log_rows(df, score, model_version, **options).write.mode("append").parquet(path)


def recent_predictions(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    return newest(spark.read.schema(LOG_SCHEMA).parquet(path), limit)


def newest(log: DataFrame, limit: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    return log.orderBy(F.desc("created_at"), *ties).limit(int(limit))

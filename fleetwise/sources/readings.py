"""Reading and writing the readings table and user batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.functions.scalars import nan_to_null, to_number
from fleetwise.operators.ordered import rank_within
from fleetwise.operators.projection import Unscorable, float_columns, require_columns
from fleetwise.spec import DEFAULT, TelemetrySpec


def schema_of(spec: TelemetrySpec = DEFAULT) -> T.StructType:
    return T.StructType(
        [
            T.StructField(spec.unit, T.LongType(), False),
            T.StructField(spec.time, T.IntegerType(), False),
            T.StructField(spec.clock, T.DoubleType()),
            *[T.StructField(s, T.DoubleType()) for s in spec.signals],
            T.StructField(spec.target, T.IntegerType()),
            T.StructField(spec.mode, T.StringType()),
            T.StructField(spec.family, T.StringType()),
            T.StructField(spec.outlier, T.BooleanType()),
        ]
    )


def clean_signals(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Signals as doubles, with NaN turned into NULL once and for all."""
    return df.withColumns({s: nan_to_null(F.col(s).cast("double")) for s in spec.signals})


def load_readings(
    spark: SparkSession, path: str, spec: TelemetrySpec = DEFAULT, *, labelled: bool = True
) -> DataFrame:
    df = spark.read.parquet(path)
    labels = (spec.target,) if labelled else ()
    require_columns(df, [spec.unit, *spec.signals, *labels], "load_readings")
    df = clean_signals(df, spec)
    if labelled:
        df = df.withColumn(spec.target, F.col(spec.target).cast("int"))
    if spec.time not in df.columns:
        require_columns(df, [spec.clock], "load_readings")
        df = rank_within(df, [spec.unit], [spec.clock], spec.time)
        df = df.withColumn(spec.time, F.col(spec.time).cast("int"))
    return df


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A user's CSV or Parquet batch. All CSV columns are text until they are mapped."""
    kind = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if kind == "csv":
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise Unscorable(f"unsupported file type: {path}")
    if not df.columns or df.isEmpty():
        raise Unscorable("the batch has no rows or no columns")
    plain = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))
    ]
    seen = df.agg(*[F.count(to_number(c)).alias(c) for c in plain]).first() if plain else ()
    if not any(seen):
        raise Unscorable("the batch has no numeric column")
    return df


def as_sample(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """The columns a model consumes, with doubles narrowed to 32 bit."""
    keep = [spec.unit, spec.clock, *spec.signals, *spec.label_side]
    df = df.select(*[c for c in keep if c in df.columns])
    return df.withColumns({c: F.col(c).cast("float") for c in float_columns(df)})


def write_sample(df: DataFrame, path: str, spec: TelemetrySpec = DEFAULT) -> None:
    as_sample(df, spec).write.option("compression", "zstd").parquet(path)

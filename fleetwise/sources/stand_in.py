"""Readings and metadata tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.operators.ordered import rank_within
from fleetwise.shared import new_path
from fleetwise.sources.readings import schema_of

_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
_PLACED = """
SELECT *, CAST(CASE WHEN unit_id % 2 = 0 THEN 200 + (unit_id * 37) % 300 END AS BIGINT) AS event_idx,
  CASE unit_id % 6 WHEN 0 THEN 'overheat' WHEN 2 THEN 'oil_starve' WHEN 4 THEN 'bearing' ELSE '' END AS unit_mode
FROM {numbered}"""

_LABELLED = """
SELECT *, CASE WHEN t_index >= event_idx - 84 AND t_index < event_idx THEN 1 ELSE 0 END AS hit,
  CASE WHEN t_index >= event_idx - 84 AND t_index < event_idx
       THEN CAST(84 - (event_idx - t_index) AS DOUBLE) / 84e0 ELSE 0e0 END AS ramp,
  CASE WHEN t_index % 211 = 17 THEN 'obvious_outlier'
       WHEN t_index % 173 = 5 THEN 'joint_outlier'
       WHEN unit_id % 4 = 1 AND t_index % 300 BETWEEN 100 AND 107 THEN 'sensor_stuck'
       WHEN unit_id % 4 = 3 AND t_index % 250 BETWEEN 50 AND 69 THEN 'sensor_drift'
       ELSE '' END AS anomaly_type
FROM {placed}"""

_READINGS = """
SELECT unit_id, t_index, CAST(t_index AS DOUBLE) * 2e0 AS timestamp_h,
  CASE WHEN anomaly_type = 'joint_outlier' THEN 700e0 ELSE 1000e0 + 20e0 * q END AS engine_speed_rpm,
  CASE WHEN anomaly_type = 'obvious_outlier' THEN 400e0
       ELSE 80e0 + 100e0 * d + CASE WHEN unit_mode = 'overheat' THEN 40e0 * ramp ELSE 0e0 END END AS coolant_temp_c,
  300e0 + 1000e0 * x - CASE WHEN unit_mode = 'oil_starve' THEN 150e0 * ramp ELSE 0e0 END AS oil_pressure_kpa,
  CASE WHEN anomaly_type = 'joint_outlier' THEN 95e0 ELSE 2e0 * q END AS engine_load_pct,
  CASE WHEN anomaly_type = 'sensor_stuck' THEN 55.5e0 ELSE p / 1000e0 END AS fuel_rate_lph,
  CASE WHEN anomaly_type = 'sensor_drift' THEN 200e0 + 3e0 * (t_index % 250)
       ELSE 100e0 + p / 1000e0 END AS boost_pressure_kpa,
  CASE WHEN unit_id % 5 <> 0 THEN 450e0 + 2e0 * q
       + CASE WHEN unit_mode = 'overheat' THEN 80e0 * ramp ELSE 0e0 END END AS egt_c,
  CASE WHEN unit_id % 5 <> 0 THEN 100e0 - (t_index % 100) END AS def_level_pct,
  CASE WHEN unit_id % 5 <> 0 THEN 4e0 + 50e0 * d
       + CASE WHEN unit_mode = 'bearing' THEN 10e0 * ramp ELSE 0e0 END END AS vibration_mms,
  hit AS failure_within_h,
  CASE WHEN hit = 1 THEN unit_mode ELSE '' END AS failure_mode,
  anomaly_type, anomaly_type <> '' AS is_outlier
FROM {labelled}"""

_written: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Write a derived table the first time an application asks for it."""
    path, schema = once_at(spark, sf_dir, name, make)
    return spark.read.schema(schema).parquet(path)


def once_at(spark: SparkSession, sf_dir: str, name: str, make) -> tuple[str, T.StructType]:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _written:
        df, path = make(), new_path(spark, name, lasting=True)
        df.write.option("compression", "zstd").parquet(path)
        _written[key] = (path, df.schema)
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_readings(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    """Labelled telemetry from ``lineitem``; suppliers are units, ship order is time."""
    rows = lineitem.select(
        F.col("l_suppkey").cast("bigint").alias("unit_id"),
        *_ORDER,
        F.col("l_extendedprice").alias("p"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("x"),
    )
    numbered = rank_within(rows, ["unit_id"], _ORDER, "t_index", keep=["unit_id", "l_quantity", "p", "d", "x"]).select(
        "unit_id", F.col("t_index").cast("int").alias("t_index"), F.col("l_quantity").alias("q"), "p", "d", "x"
    )
    placed = spark.sql(_PLACED, numbered=numbered)
    labelled = spark.sql(_LABELLED, placed=placed)
    out = spark.sql(_READINGS, labelled=labelled)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema_of().fields])


def readings_at(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    make = lambda: derive_readings(spark, table(spark, sf_dir, "lineitem"))
    return once_at(spark, sf_dir, "readings", make)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = readings_at(spark, sf_dir)
    return spark.read.schema(schema).parquet(path)


def readings_sql() -> str:
    """The same derivation as one SQL text over ``lineitem``."""
    order = ", ".join(_ORDER)
    return f"""WITH o AS (SELECT CAST(l_suppkey AS BIGINT) AS unit_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) - 1 AS INT) AS t_index,
  l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x FROM lineitem),
e AS ({_PLACED.format(numbered="o")}), f AS ({_LABELLED.format(placed="e")})
{_READINGS.format(labelled="f")}"""

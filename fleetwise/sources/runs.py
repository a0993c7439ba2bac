"""Stored runs: their readings, roll-ups, states and retention, as partitioned Parquet tables.

Layout under one root: ``run_readings`` by run, ``run_units`` by run and model version, and
``run_events``, an append-only log of state changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.functions.scalars import (
    ERROR_TEXT_LIMIT,
    short_error,
    signal_map,
    signals_from_map,
)
from fleetwise.operators.ordered import running_totals
from fleetwise.operators.projection import require_columns
from fleetwise.shared import remove, stored
from fleetwise.spec import DEFAULT, ROW_BUDGET, TelemetrySpec

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_RUNS = 16

FINISHED = ("succeeded", "failed")
EVICTED = "evicted"
STATES = ("queued", "running", *FINISHED, EVICTED)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("at", T.TimestampType(), False),
        T.StructField("n_units", T.IntegerType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
READING_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("t_index", T.IntegerType()),
        T.StructField("readings", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("run_id", T.StringType()),
    ]
)
UNIT_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("risk", T.DoubleType()),
        T.StructField("peak", T.DoubleType()),
        T.StructField("high_risk_share", T.DoubleType()),
        T.StructField("flagged", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
    ]
)


def pack_readings(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """(unit, t, signal map); labels are dropped."""
    require_columns(df, [*spec.key, *spec.signals], "append_run_readings")
    return df.select(
        F.col(spec.unit).cast("string").alias("unit_id"),
        F.col(spec.time).cast("int").alias("t_index"),
        signal_map(spec.signals).alias("readings"),
    )


def unpack_readings(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Back to wide form; a signal that the map lacks becomes NULL."""
    return df.select("unit_id", "t_index", *signals_from_map(F.col("readings"), spec.signals))


def page_of(
    df: DataFrame, offset: int = 0, limit: int = 50, after: tuple[str, int] | None = None
) -> DataFrame:
    """``limit`` rows by unit and time, behind the row ``after`` (unit, t) or behind ``offset`` rows.

    ``after`` is the way through a long table: rows up to it are filtered out, and every task keeps
    ``limit`` rows. With ``offset`` every task keeps ``offset + limit``, so it is for the first pages.
    """
    if after is not None:
        unit, t = after
        later = (F.col("unit_id") > unit) | ((F.col("unit_id") == unit) & (F.col("t_index") > t))
        df = df.filter(later)
    return df.orderBy("unit_id", "t_index").offset(max(0, int(offset))).limit(max(1, int(limit)))


def current_state(events: DataFrame) -> DataFrame:
    """One row per run from its state changes, the latest first."""
    at = lambda status: F.min(F.when(F.col("status").isin(*status), F.col("at")))
    latest = F.max_by(F.struct("status", "n_rows", "error"), F.struct("at", _progress()))
    return (
        events.groupBy("run_id")
        .agg(
            latest.alias("_now"),
            F.max("n_units").alias("n_units"),
            F.max("days").alias("days"),
            F.max("seed").alias("seed"),
            at(["queued"]).alias("created_at"),
            at(["running"]).alias("started_at"),
            at(FINISHED).alias("finished_at"),
        )
        .select(
            "run_id",
            F.col("_now.status").alias("status"),
            "n_units",
            "days",
            "seed",
            "created_at",
            "started_at",
            "finished_at",
            F.coalesce(F.col("_now.n_rows"), F.lit(0).cast("bigint")).alias("n_rows"),
            short_error(F.col("_now.error")).alias("error"),
        )
    )


def _progress():
    """Orders two state changes of one instant."""
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))


def evictable(
    runs: DataFrame, budget: int = ROW_BUDGET, keep: Sequence[str] = (), total: int | None = None
) -> DataFrame:
    """The oldest finished runs to drop until the store fits ``budget`` rows.

    Runs in flight and those in ``keep`` count towards the total but never go. ``total`` is the
    stored row count when it is known apart from the run rows.
    """
    if total is None:
        total = runs.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    candidates = runs.filter(F.col("status").isin(*FINISHED) & ~F.col("run_id").isin(list(keep)))
    age = F.struct("created_at", "run_id").alias("_age")
    sized = candidates.select(age, F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n"))
    run = running_totals(sized, [], "_age", ["n"])
    gone = run.filter(F.lit(int(total)) - (F.col("cum_n") - F.col("n")) > F.lit(int(budget)))
    return gone.select(
        F.col("_age.run_id").alias("run_id"),
        F.col("_age.created_at").alias("created_at"),
        F.col("n").alias("n_rows"),
    )


class RunStore:
    """The stored tables under ``root``, a folder on shared storage."""

    def __init__(self, spark: SparkSession, root: str, spec: TelemetrySpec = DEFAULT):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        for name, schema, keys in (
            ("run_readings", READING_SCHEMA, ["run_id"]),
            ("run_units", UNIT_SCHEMA, ["run_id", "model_version"]),
            ("run_events", EVENT_SCHEMA, []),
        ):
            empty = spark.createDataFrame([], schema)
            empty.write.mode("append").partitionBy(*keys).parquet(f"{self.root}/{name}")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _event(self, run_id: str, status: str, **values) -> None:
        row = {
            "run_id": run_id,
            "status": status,
            "at": values.pop("at", None) or datetime.now(timezone.utc),
            **{f.name: values.get(f.name) for f in EVENT_SCHEMA.fields[3:]},
        }
        self.spark.createDataFrame([row], EVENT_SCHEMA).write.mode("append").parquet(
            f"{self.root}/run_events"
        )

    def create_run(self, run_id: str, n_units: int, days: int, seed: int, at=None) -> None:
        self._event(
            run_id, "queued", n_units=n_units, days=days, seed=seed, n_rows=0, at=at
        )

    def mark_running(self, run_id: str, at=None) -> None:
        self._event(run_id, "running", at=at)

    def mark_succeeded(self, run_id: str, n_rows: int, at=None) -> None:
        self._event(run_id, "succeeded", n_rows=int(n_rows), at=at)

    def mark_failed(self, run_id: str, error: object, at=None) -> None:
        self._event(run_id, "failed", error=str(error)[:ERROR_TEXT_LIMIT], at=at)

    def runs(self) -> DataFrame:
        """All runs that are still stored."""
        states = current_state(self._table("run_events", EVENT_SCHEMA))
        return states.filter(F.col("status") != EVICTED)

    def append_readings(self, run_id: str, df: DataFrame) -> int:
        self.append_packed(pack_readings(df, self.spec).withColumn("run_id", F.lit(run_id)))
        return self.count_readings(run_id)

    def append_packed(self, packed: DataFrame) -> None:
        """Rows of any number of runs, already in the stored form.

        A task keeps a file open for each of its first ``OPEN_RUNS`` runs, so that the wide maps need not be
        sorted by run; rows of further runs are.
        """
        conf, before = self.spark.conf, self.spark.conf.get(_WRITERS)
        conf.set(_WRITERS, str(max(OPEN_RUNS, int(before))))
        try:
            packed.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/run_readings")
        finally:
            conf.set(_WRITERS, before)

    def counts(self) -> DataFrame:
        return self.all_rows().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def all_rows(self) -> DataFrame:
        return self._table("run_readings", READING_SCHEMA)

    def run_rows(self, run_id: str) -> DataFrame:
        return self._table("run_readings", READING_SCHEMA).filter(F.col("run_id") == run_id)

    def readings(self, run_id: str) -> DataFrame:
        return unpack_readings(self.run_rows(run_id), self.spec)

    def page(
        self, run_id: str, offset: int = 0, limit: int = 50, after: tuple[str, int] | None = None
    ) -> DataFrame:
        return unpack_readings(page_of(self.run_rows(run_id), offset, limit, after), self.spec)

    def count_readings(self, run_id: str) -> int:
        return self.run_rows(run_id).count()

    def total_readings(self) -> int:
        return self._table("run_readings", READING_SCHEMA).count()

    def save_report(self, run_id: str, model_version: str, rollup: DataFrame) -> None:
        """Replace the roll-up of this run under this model version, and no other."""
        rows = rollup.select(
            F.col(self.spec.unit).cast("string").alias("unit_id"),
            F.col("n_rows").cast("int").alias("n_rows"),
            "risk",
            "peak",
            "high_risk_share",
            "flagged",
            F.lit(run_id).alias("run_id"),
            F.lit(str(model_version)).alias("model_version"),
        )
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_id", "model_version"
        ).parquet(f"{self.root}/run_units")

    def load_report(self, run_id: str, model_version: str) -> DataFrame:
        """Riskiest first; empty when this model version has not reported on the run."""
        return (
            self._table("run_units", UNIT_SCHEMA)
            .filter((F.col("run_id") == run_id) & (F.col("model_version") == str(model_version)))
            .orderBy(F.desc("risk"), "unit_id")
        )

    def prune(self, budget: int = ROW_BUDGET, keep: Sequence[str] = ()) -> int:
        """Drop the oldest finished runs; returns how many went.

        The state log notes the runs as evicted before anything is removed: a job that dies in
        between leaves files that no run names, never a run without its rows. ``sweep`` removes them.
        """
        gone = stored(
            evictable(self.runs(), budget, keep, self.total_readings()).select("run_id"), "gone"
        )
        n = gone.count()
        if n:
            none = {f.name: F.lit(None).cast(f.dataType) for f in EVENT_SCHEMA.fields[3:]}
            events = gone.select(
                "run_id",
                F.lit(EVICTED).alias("status"),
                F.current_timestamp().alias("at"),
                *[c.alias(k) for k, c in none.items()],
            )
            events.write.mode("append").parquet(f"{self.root}/run_events")
            self.sweep(gone)
        return n

    def sweep(self, gone: DataFrame | None = None) -> None:
        """Remove the folders of evicted runs: of ``gone``, by default of all that were ever evicted.

        A run's files lie in folders of their own, so nothing is rewritten. These are file-system calls,
        two per run; no rows come to the driver but the run names, one at a time.
        """
        if gone is None:
            states = current_state(self._table("run_events", EVENT_SCHEMA))
            gone = states.filter(F.col("status") == EVICTED).select("run_id")
        for row in gone.toLocalIterator():
            for name in ("run_readings", "run_units"):
                remove(self.spark, f"{self.root}/{name}/run_id={row['run_id']}")

"""Drift between any two periods from stored quantile sketches, without reading rows again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetwise.operators.drift import DISTANCE_CUT, SCALE_FLOOR
from fleetwise.operators.projection import select_features
from fleetwise.shared import exists
from fleetwise.spec import DEFAULT, TelemetrySpec

SIZE = 2048  # entries of a sketch; some 20 kB each
POINTS = 1000  # quantiles that are compared


def rank_error(size: int = SIZE) -> float:
    """How far a rank from a sketch may be off (99 %), as a share of all values; the figure of the sketch's authors."""
    return 2.446 / size**0.9433


def slice_sketches(df: DataFrame, slice_: Column, spec: TelemetrySpec = DEFAULT, size: int = SIZE) -> DataFrame:
    """``slice``, ``signal``, ``n``, ``mean``, ``spread`` (sum of squared deviations) and ``sketch``.

    Sketches are built before the shuffle, so it carries one for every task, slice and signal. A signal that a slice
    lacks has no row.
    """
    wide = select_features(df.withColumn("_slice", slice_.cast("bigint")), spec, ["_slice"])
    long = wide.unpivot(["_slice"], list(spec.signals), "signal", "value").where("value IS NOT NULL")
    return long.groupBy(F.col("_slice").alias("slice"), "signal").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("spread"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"),
    )


def merged(slices: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per signal over all the slices."""
    centres = slices.groupBy("signal").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_centre"))
    apart = F.col("mean") - F.col("_centre")
    return slices.join(centres, "signal").groupBy("signal").agg(
        F.sum("n").alias("n"),
        F.max("_centre").alias("mean"),
        F.sum(F.col("spread") + F.col("n") * apart * apart).alias("spread"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )


def sketch_distances(reference: DataFrame, current: DataFrame, size: int = SIZE, cut: float = DISTANCE_CUT) -> DataFrame:
    """KS and Wasserstein distance of two merged sides per signal, with the error that the sketches leave.

    Each side stands for ``POINTS`` + 1 quantiles of equal weight. A step function of them differs from the whole
    distribution by at most the rank error and one weight, so KS is off by twice that and Wasserstein by that
    times the width of the values. ``certain`` says whether the verdict holds whatever the error. A signal that either
    side lacks has NULL distances and has not drifted.
    """
    ranks = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])

    def points(side: DataFrame, ref: int) -> DataFrame:
        value = F.explode(F.kll_sketch_get_quantile_double("sketch", ranks))
        return side.select("signal", value.alias("v"), F.lit(ref).alias("r"), F.lit(1 - ref).alias("c"))

    both = points(reference, 1).unionByName(points(current, 0))
    steps = both.groupBy("signal", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    upto = Window.partitionBy("signal").orderBy("v")  # at most 2 * (POINTS + 1) rows a signal
    gap = F.abs(F.sum("r").over(upto) - F.sum("c").over(upto)) / F.lit(POINTS + 1.0)
    run = steps.select("signal", "v", gap.alias("gap"), F.lead("v").over(upto).alias("next"))
    found = run.groupBy("signal").agg(
        F.max("gap").alias("ks"),
        F.sum(F.col("gap") * F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))).alias("wasserstein"),
        (F.max("v") - F.min("v")).alias("_width"),
    )
    off = F.lit(2.0 * (rank_error(size) + 1.0 / POINTS))
    ref = reference.select("signal", F.col("n").alias("n_ref"), F.sqrt(F.col("spread") / F.col("n")).alias("ref_std"))
    sides = ref.join(current.select("signal", F.col("n").alias("n_cur")), "signal", "full").fillna(0, ["n_ref", "n_cur"])
    out = sides.join(found, "signal")
    two = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    floor = F.greatest(F.col("ref_std"), F.lit(SCALE_FLOOR))
    out = out.select(
        "signal",
        "n_ref",
        "n_cur",
        F.when(two, F.col("ks")).alias("ks"),
        F.when(two, off).alias("ks_error"),
        F.when(two, F.col("wasserstein")).alias("wasserstein"),
        F.when(two, off * F.col("_width")).alias("wasserstein_error"),
        "ref_std",
        F.when(two, F.col("wasserstein") / floor).alias("wasserstein_norm"),
    )
    certain = F.abs(F.col("wasserstein_norm") - cut) > F.col("wasserstein_error") / floor
    return out.select(
        "*",
        F.coalesce(F.col("wasserstein_norm") >= cut, F.lit(False)).alias("drifted"),
        F.coalesce(certain, F.lit(False)).alias("certain"),
    )


class SketchStore:
    """Sketches per time slice and signal, one folder a batch; a batch that comes again replaces itself.

    Periods are half-open ranges of slices. They cost as many small rows as they have slices, batches and signals.
    """

    def __init__(self, spark: SparkSession, path: str, slice_: Column, spec: TelemetrySpec = DEFAULT, size: int = SIZE) -> None:
        self.spark, self.path, self.slice, self.spec, self.size = spark, path.rstrip("/"), slice_, spec, size

    def add(self, batch: str, rows: DataFrame) -> None:
        sketches = slice_sketches(rows, self.slice, self.spec, self.size)
        sketches.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def period(self, first: int, end: int) -> DataFrame:
        """The merged sketches of slices ``first`` to ``end`` - 1."""
        if not exists(self.spark, self.path):
            raise ValueError(f"no batch in {self.path}")
        slices = self.spark.read.option("recursiveFileLookup", True).parquet(self.path)
        return merged(slices.where((F.col("slice") >= first) & (F.col("slice") < end)), self.size)

    def drift(self, reference: tuple[int, int], current: tuple[int, int], cut: float = DISTANCE_CUT) -> DataFrame:
        return sketch_distances(self.period(*reference), self.period(*current), self.size, cut)

    def watch(self, stream: DataFrame, checkpoint: str, prefix: str = "stream") -> StreamingQuery:
        """Keep the sketches of a stream: a batch that is repeated after a failure replaces its own folder."""
        keep: Callable[[DataFrame, int], None] = lambda rows, number: self.add(f"{prefix}-{number}", rows)
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

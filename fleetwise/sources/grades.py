"""A stored grading state: counts per slice and score, to which batches add and from which every metric comes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwise.operators import grading as gr
from fleetwise.operators.ordered import running_totals
from fleetwise.shared import exists, remove
from fleetwise.spec import ALARM_BUDGET

CELLS = 1024  # of the range index over the scores
_BATCH, _CELL = "batch", "cell"


class GradeStore:
    """Rows and positives per (``by``, score), one folder a batch.

    A batch is counted once, when it comes: the graded rows are never read again. Adding a batch a second time
    replaces it, so a job may be repeated. ``compact`` folds the batches known by then into one base; a batch that it holds
    is refused from then on. Beside the counts lies a range index, one row per slice and cell of scores, from which a cut is
    found by reading the counts of one cell alone. Scores from 0 to 1 spread over the cells; others share the outer ones.

    Folders: ``counts/batch=<id>``, ``index/batch=<id>``, ``bases/<number>`` with counts, index and the names of its
    batches, which are written last: a base without names is not there. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ()) -> None:
        taken = {"score", "n", "pos", _CELL} & set(by)
        if taken:
            raise ValueError(f"columns of the store itself: {sorted(taken)}")
        self.spark, self.path, self.by = spark, path.rstrip("/"), tuple(by)

    # -- writing ---------------------------------------------------------------------------------

    def add(self, batch: str, rows: DataFrame, score: str, label: str) -> None:
        """Count a batch of graded rows: ``label`` is 1 or true for positives, rows without score do not count."""
        if self._in_base(batch):
            raise ValueError(f"batch {batch} is part of a base already")
        clean = rows.where(F.col(score).isNotNull())
        slim = clean.select(*self.by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"))
        place = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(F.col("score") * CELLS))).cast("int")
        counts = gr.score_counts(slim, "score", "_y", self.by).withColumn(_CELL, place)
        self._write(counts, f"{self.path}/{{}}/{_BATCH}={batch}")

    def compact(self) -> None:
        """One base instead of the last base and all batches since."""
        number = self._base() + 1
        names = self._fresh() + self._names()
        self._write(self.counts(), f"{self.path}/bases/{number}/{{}}")
        known = self.spark.createDataFrame([(n,) for n in names], f"{_BATCH} string")
        known.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bases/{number}/names")

    def _write(self, counts: DataFrame, where: str) -> None:
        keys = [*self.by, _CELL]
        remove(self.spark, where.format("index"))  # it says that the counts are whole, so it goes first
        laid = counts.repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
        laid.write.mode("overwrite").parquet(where.format("counts"))
        index = self.spark.read.parquet(where.format("counts")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        index.write.mode("overwrite").parquet(where.format("index"))

    # -- what is there ---------------------------------------------------------------------------

    def _listed(self, folder: str) -> list[str]:
        if not exists(self.spark, folder):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]

    def _base(self) -> int:
        """The number of the last whole base, 0 for none."""
        whole = [int(n) for n in self._listed(f"{self.path}/bases") if exists(self.spark, f"{self.path}/bases/{n}/names/_SUCCESS")]
        return max(whole, default=0)

    def _names(self) -> list[str]:
        base = self._base()
        if not base:
            return []
        return [r[0] for r in self.spark.read.parquet(f"{self.path}/bases/{base}/names").collect()]  # one name a batch

    def _in_base(self, batch: str) -> bool:
        base = self._base()
        return bool(base) and not self.spark.read.parquet(f"{self.path}/bases/{base}/names").where(F.col(_BATCH) == batch).isEmpty()

    def _fresh(self) -> list[str]:
        """Batches that are whole (their index is written last) and not in the base."""
        done, prefix = set(self._names()), f"{_BATCH}="
        found = [n for n in self._listed(f"{self.path}/index") if exists(self.spark, f"{self.path}/index/{n}/_SUCCESS")]
        return sorted(n.removeprefix(prefix) for n in found if n.removeprefix(prefix) not in done)

    def _parts(self, kind: str) -> DataFrame:
        base = self._base()
        folders = [f"{self.path}/{kind}/{_BATCH}={n}" for n in self._fresh()]
        folders += [f"{self.path}/bases/{base}/{kind}"] if base else []
        if not folders:
            raise ValueError(f"no batch in {self.path}")
        return self.spark.read.option("recursiveFileLookup", True).parquet(*folders)

    # -- reading ---------------------------------------------------------------------------------

    def counts(self) -> DataFrame:
        """``by``, ``score``, ``n``, ``pos`` and the cell, over all batches."""
        return self._parts("counts").groupBy(*self.by, _CELL, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))

    def roc_auc(self) -> DataFrame:
        return gr.auc_from(self.counts(), "score", self.by)

    def average_precision(self) -> DataFrame:
        return gr.precision_from(self.counts(), "score", self.by)

    def threshold_sweep(self) -> DataFrame:
        return gr.sweep_from(self.counts(), "score", self.by)

    def calibration(self, bins: int = gr.BINS) -> DataFrame:
        """As ``grading.calibration``, per slice."""
        place = gr.bin_of("score", bins)
        sums = self.counts().groupBy(*self.by, place.alias("bin")).agg(
            F.sum(F.col("score") * F.col("n")).alias("_s"), F.sum("pos").alias("_p"), F.sum("n").alias("n")
        )
        n = F.col("n").cast("double")
        return sums.select(*self.by, "bin", (F.col("_s") / n).alias("mean_predicted"), (F.col("_p") / n).alias("observed_rate"), "n")

    def alarm_cuts(self, budget: float = ALARM_BUDGET) -> DataFrame:
        """Per slice the lowest score that still alarms; NULL when even the top tie overflows the budget.

        The index says in which cell the budget runs out. Only that cell's counts are read, and summed in order.
        """
        index = self._parts("index").groupBy(*self.by, _CELL).agg(F.sum("n").alias("n"))
        down = Window.partitionBy(*self.by).orderBy(F.desc(_CELL))  # at most CELLS rows a slice
        cells = index.select(
            *self.by,
            F.col(_CELL).alias("_cell"),
            (F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_above"),
            gr.budget_rows(F.sum("n").over(Window.partitionBy(*self.by)), budget).alias("_may"),
            F.col("n").alias("_in"),
        )
        edge = cells.where("_above <= _may AND _above + _in > _may").withColumnsRenamed({c: f"_of_{c}" for c in self.by})
        counts = self._parts("counts")
        asked = [r[0] for r in edge.select("_cell").distinct().collect()]  # at most CELLS numbers
        counts = counts.where(F.col(_CELL).isin(asked)) if asked else counts.where(F.lit(False))
        inside = counts.groupBy(*self.by, _CELL, "score").agg(F.sum("n").alias("n"))
        run = running_totals(inside, [*self.by, _CELL], "score", ["n"], descending=True)
        same = F.col(_CELL) == F.col("_cell")
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        within = run.join(edge, same).where("_above + cum_n <= _may")
        found = within.groupBy(*self.by).agg(F.min("score").alias("_cut"))
        # nothing of that cell alarms: the cut is the lowest score of the cells above it
        above = cells.where("_above + _in <= _may").groupBy(*self.by).agg(F.min("_cell").alias("_lowest"))
        lows = self._lowest(above)
        slices = index.select(*self.by).distinct() if self.by else index.agg(F.count(F.lit(1)).alias("_rows"))
        out = slices
        for side in (found, lows):
            if self.by:
                named = side.withColumnsRenamed({c: f"_k_{c}" for c in self.by})
                match = F.lit(True)
                for c in self.by:
                    match &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
                out = out.join(named, match, "left").drop(*[f"_k_{c}" for c in self.by])
            else:
                out = out.join(side, F.lit(True), "left")  # one row each
        return out.select(*self.by, F.coalesce("_cut", "_low").alias("alarm_cut"))

    def _lowest(self, above: DataFrame) -> DataFrame:
        """Per slice the lowest score of the cell ``_lowest``."""
        asked = [r[0] for r in above.select("_lowest").distinct().collect() if r[0] is not None]  # at most CELLS numbers
        counts = self._parts("counts")
        counts = counts.where(F.col(_CELL).isin(asked)) if asked else counts.where(F.lit(False))
        lows = counts.groupBy(*self.by, _CELL).agg(F.min("score").alias("_low"))
        named = above.withColumnsRenamed({c: f"_of_{c}" for c in self.by})
        same = F.col(_CELL) == F.col("_lowest")
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return lows.join(named, same).select(*self.by, "_low")

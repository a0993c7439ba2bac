"""Which model version is live: the promotion gate, alone and replayed over a history."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.operators.ordered import best_before, running_totals
from fleetwise.shared import exists, stored

REASONS = ("first", "same", "passed", "rejected", "forced", "no_metric")

class PromotionError(RuntimeError):
    """A promotion that cannot be evaluated, or nothing to return to."""


def latest_version(scores: DataFrame) -> DataFrame:
    return scores.groupBy("name").agg(F.max(F.col("version").cast("bigint")).alias("version"))


def best_run(scores: DataFrame, by: str = "name", order: str = "contender_order") -> DataFrame:
    """The best metric per name; a tie goes to the contender that comes first."""
    w = Window.partitionBy(by).orderBy(F.col("roc_auc").desc_nulls_last(), F.col(order).asc())
    return scores.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def _decided(df: DataFrame, min_delta: float) -> DataFrame:
    """Compare (roc_auc, version, forced) with (live_version, live_auc)."""
    usable = F.col("roc_auc").isNotNull()
    why = (
        F.when(~usable, "no_metric")
        .when(F.col("forced"), "forced")
        .when(F.col("live_version").isNull(), "first")
        .when(F.col("live_version") == F.col("version"), "same")
        .when(F.col("roc_auc") >= F.col("live_auc") - F.lit(min_delta), "passed")
        .otherwise("rejected")
    )
    same = F.col("live_version") == F.col("version")
    return df.withColumn("reason", why).select(
        "name",
        "seq",
        "version",
        "roc_auc",
        "forced",
        F.col("live_version").alias("incumbent_version"),
        F.when(~same, F.col("live_auc")).alias("incumbent_auc"),
        F.col("reason").isin("forced", "first", "same", "passed").alias("promoted"),
        "reason",
    )


def gate(requests: DataFrame, live: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """Decide one request per name (name, seq, version, roc_auc, forced) against what is live.

    ``live`` holds (name, live_version, live_auc); a name without a row has no live version. A
    candidate passes when it is at most ``min_delta`` worse.
    """
    return _decided(requests.join(live, "name", "left"), min_delta)


def promotion_history(requests: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """Replay all requests in ``seq`` order per name, each against what the ones before it left live.

    ``seq`` is unique within a name, and a version has one metric. A candidate passes when it is at most
    ``min_delta`` worse than the live version, so with a tolerance the live metric can sink step by step.
    """
    if not 0.0 <= min_delta < math.inf:
        raise PromotionError(f"a tolerance of {min_delta} decides nothing")
    return _tolerant_history(requests, min_delta) if min_delta else _strict_history(requests)


def _strict_history(requests: DataFrame) -> DataFrame:
    """Without tolerance the live version is the best one so far, the newest on a tie, counted from
    the last forced request. So it is a running maximum over (forced so far, metric, seq), which
    needs no row-by-row loop.
    """
    counts = requests.withColumn(
        "_force", F.when(F.col("forced") & F.col("roc_auc").isNotNull(), 1).otherwise(0)
    )
    marked = running_totals(counts, ["name"], "seq", ["_force"]).withColumn(
        "_state",
        F.when(
            F.col("roc_auc").isNotNull(), F.struct("cum__force", "roc_auc", "seq", "version")
        ),
    )
    marked = marked.select(*requests.columns, "_state")
    replay = best_before(marked, ["name"], "seq", {"_live": "_state"})
    return _decided(
        replay.select(
            *requests.columns,
            F.col("_live.version").alias("live_version"),
            F.col("_live.roc_auc").alias("live_auc"),
        ),
        0.0,
    )


def _replayed(pdf: pd.DataFrame, live: tuple[int, float] | None, min_delta: float) -> list[tuple[int, float] | None]:
    """What is live before each request of a sorted block, and after the last one."""
    out = []
    for version, auc, forced in zip(pdf["version"].tolist(), pdf["roc_auc"].tolist(), pdf["forced"].tolist()):
        out.append(live)
        if auc == auc and (forced or live is None or auc >= live[1] - min_delta):
            live = (version, auc)
    return [*out, live]


_BLOCK = "_part int, top double, version bigint, roc_auc double"
_LIVE = "live_version bigint, live_auc double"


def _tolerant_history(requests: DataFrame, min_delta: float) -> DataFrame:
    """A block of consecutive requests as a function of the metric that is live before it.

    Where the block's best request passes, it makes itself live whatever came before, and from there on
    everything in the block is settled. So a block either leaves a live version alone (its best request
    fails: none passes) or ends in one state, the state in which it ends when nothing is live before
    it. A forced request counts as infinitely good. Two numbers a block are therefore enough to carry the
    live version from block to block; the blocks are then replayed side by side. A NaN metric is none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    usable = F.when(~F.isnan("roc_auc"), F.col("roc_auc").cast("double"))
    laid = stored(
        requests.withColumns({"roc_auc": usable, "forced": F.coalesce("forced", F.lit(False))})
        .repartitionByRange("name", "seq")
        .withColumn("_part", F.spark_partition_id()),
        "requests",
    )

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        usable = pdf["roc_auc"].where(~(pdf["forced"] & pdf["roc_auc"].notna()), math.inf)
        end = _replayed(pdf, None, min_delta)[-1] or (None, None)
        row = {"name": pdf["name"].iloc[:1], "_part": pdf["_part"].iloc[0], "top": usable.max()}
        return pd.DataFrame(row).assign(version=pd.array([end[0]], "Int64"), roc_auc=end[1])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        """The live version before each block of one name; there is a row per partition at most."""
        live, before = None, []
        pdf = pdf.sort_values("_part")
        # blocks without a usable metric change nothing
        for top, version, auc in zip(pdf["top"], pdf["version"].astype("Int64"), pdf["roc_auc"]):
            before.append(live)
            if top == top and (live is None or top >= live[1] - min_delta):
                live = (int(version), auc)
        return pdf[["name", "_part"]].assign(**_columns(before))

    def decided(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        first = pdf.iloc[0]
        live = None if pd.isna(first["start_auc"]) else (int(first["start_version"]), first["start_auc"])
        return pdf[["name", "seq", "version", "roc_auc", "forced"]].assign(
            **_columns(_replayed(pdf, live, min_delta)[:-1])
        )

    name = f"name {kinds['name']}"
    needed = laid.select("name", "seq", F.col("version").cast("bigint").alias("version"), "roc_auc", "forced", "_part")
    blocks = needed.groupBy("name", "_part").applyInPandas(summed, f"{name}, {_BLOCK}")
    starts = blocks.groupBy("name").applyInPandas(carried, f"{name}, _part int, {_LIVE}")
    starts = starts.toDF("_name", "_of", "start_version", "start_auc")
    same = F.col("name").eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_of"))
    # versions go through pandas as whole numbers: those of a start are 0 where nothing is live
    begun = needed.join(starts.fillna(0, ["start_version"]), same).drop("_name", "_of")
    out = begun.groupBy("name", "_part").applyInPandas(
        decided, f"{name}, seq {kinds['seq']}, version bigint, roc_auc double, forced boolean, {_LIVE}"
    )
    return _decided(out, min_delta)


def _columns(live: list[tuple[int, float] | None]) -> dict:
    return {
        "live_version": pd.array([None if v is None else v[0] for v in live], "Int64"),
        "live_auc": np.array([np.nan if v is None else v[1] for v in live]),
    }


def previous_version(decisions: DataFrame) -> DataFrame:
    """Per name: the live version and the one it replaced, to roll back to."""
    moved = decisions.filter(
        F.col("promoted")
        & (F.col("incumbent_version").isNull() | (F.col("incumbent_version") != F.col("version")))
    )
    last = F.max_by(F.struct("version", "incumbent_version"), "seq")
    return (
        moved.groupBy("name")
        .agg(last.alias("_last"))
        .select(
            "name",
            F.col("_last.version").alias("live_version"),
            F.col("_last.incumbent_version").alias("previous_version"),
        )
    )


def roll_back(decisions: DataFrame, name: str) -> int:
    row = previous_version(decisions.filter(F.col("name") == name)).first()
    if row is None:
        raise PromotionError(f"{name} has no live version")
    if row["previous_version"] is None:
        raise PromotionError(f"{name} version {row['live_version']} replaced no version")
    return row["previous_version"]


DECISION = (
    "name string, seq bigint, version bigint, roc_auc double, forced boolean, incumbent_version bigint,"
    " incumbent_auc double, promoted boolean, reason string, batch bigint"
)


class PromotionLog:
    """Decisions of the gate as a table that grows batch by batch; what is live follows from it.

    A batch holds one request per name, so any tolerance can be used: every request meets what the
    batches before it left live. Going back is a decision like any other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def decisions(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], DECISION)
        return self.spark.read.schema(DECISION).parquet(self.path)

    def live(self) -> DataFrame:
        """(name, live_version, live_auc) after all batches."""
        last = F.max_by(F.struct("version", "roc_auc"), "batch")
        return (
            self.decisions().filter("promoted").groupBy("name").agg(last.alias("_l"))
            .select("name", F.col("_l.version").alias("live_version"), F.col("_l.roc_auc").alias("live_auc"))
        )

    def _append(self, decided: DataFrame) -> None:
        at = (self.decisions().agg(F.max("batch")).first()[0] or 0) + 1
        rows = decided.withColumn("batch", F.lit(at).cast("bigint"))
        kinds = T.StructType.fromDDL(DECISION)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.mode("append").parquet(self.path)

    def publish(self, requests: DataFrame, min_delta: float = 0.0) -> None:
        """Decide one request per name (name, seq, version, roc_auc, forced) and keep the decisions."""
        twice = requests.groupBy("name").count().filter("count > 1").first()
        if twice:
            raise PromotionError(f"{twice['name']} asks twice in one batch")
        self._append(gate(requests, self.live(), min_delta))

    def roll_back(self, name: str) -> int:
        """Make the version live again that the live one replaced; returns it."""
        moves = self.decisions().filter((F.col("name") == name) & F.col("promoted")).withColumn("seq", F.col("batch"))
        back = roll_back(moves, name)
        before = moves.filter(F.col("version") == back).agg(F.max_by("roc_auc", "batch")).first()[0]
        now = self.live().filter(F.col("name") == name).first()
        row = [(name, None, back, before, True, now["live_version"], now["live_auc"], True, "rolled_back")]
        self._append(self.spark.createDataFrame(row, DECISION.rsplit(",", 1)[0]))
        return back

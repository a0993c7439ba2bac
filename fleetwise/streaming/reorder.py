"""Sustained risk over readings that arrive out of order: rows wait until the watermark passes them."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetwise.operators.blocks import BLOCK, POSITION, in_blocks
from fleetwise.spec import DEFAULT, HIGH_RISK, TelemetrySpec
from fleetwise.streaming.jobs import _RISK, _to_files, event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR_MS = 3_600_000


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """List states and timers need the store that keeps state on disk; a query takes the setting along when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _InOrder(StatefulProcessor):
    """A block of a unit: rows that wait, and what the folded ones left behind.

    A timer stands at the earliest waiting row. When the watermark reaches it, no earlier row can come any more:
    all rows up to the watermark are sorted by position and folded. A block whose last position is folded keeps
    nothing, since rows behind the watermark do not reach it.
    """

    def __init__(self, rows: int, size: int, idle_ms: int | None) -> None:
        self.rows, self.size, self.idle_ms = rows, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, position bigint, score double")
        self.folded = handle.getValueState("folded", "last bigint, at bigint, tail array<double>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))  # at most what a block and its context hold within the lateness
        scores = [None if pd.isna(s) else float(s) for s in new["score"]]
        self.waiting.appendList(list(zip(new["at_ms"].tolist(), new["position"].tolist(), scores, strict=True)))
        self._wake(min(int(at) for at, _, _ in self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        unit, block = key
        self.timer.clear()  # the timer itself is gone
        known = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if not known:  # idle for long enough
            self.folded.clear()
            return
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted((r for r in known if r[0] <= mark), key=lambda r: (r[1], r[0]))
        later = [r for r in known if r[0] > mark]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        last, at, tail = self.folded.get() if self.folded.exists() else (-1, 0, [])
        new = pd.DataFrame(ready, columns=["at", "position", "score"]).drop_duplicates("position")
        new = new[new["position"] > last]
        tail = list(tail)
        if len(new):
            values = pd.Series([*tail, *new["score"]], dtype="float64")
            means = values.rolling(self.rows, min_periods=1).mean().iloc[len(tail) :].to_numpy()
            own = (new["position"] >= block * self.size).to_numpy()
            last, at = int(new["position"].iloc[-1]), max(at, int(new["at"].max()))
            tail = values.iloc[len(values) - min(len(values), self.rows - 1) :].tolist()
            if own.any():
                mine = new["score"].to_numpy(dtype="float64")[own]
                yield pd.DataFrame(
                    {
                        "unit_id": [unit],
                        "block": [block],
                        "n_rows": [int(own.sum())],
                        "risk": [float(means[own].max())],
                        "peak": [float(mine.max())],
                        "n_high": [int((mine >= HIGH_RISK).sum())],
                    }
                )
        closed = last >= (block + 1) * self.size - 1
        if closed:
            self.folded.clear()
        else:
            self.folded.update((last, at, tail))
        if later:
            self._wake(min(r[0] for r in later))
        elif not closed and self.idle_ms is not None:
            self._wake(max(at + self.idle_ms, mark + 1))


def reordered_risk_stream(
    stream: DataFrame,
    score: str,
    out_path: str,
    checkpoint: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    lateness_h: int = 24,
    idle_h: int | None = None,
) -> StreamingQuery:
    """``sustained_risk_stream`` for rows that come in any order within ``lateness_h`` hours of the latest one seen.

    ``spec.clock`` must not fall as the position rises. Rows wait until the watermark (latest clock less the lateness)
    has passed them, then count as if they had come in order; so the output covers the rows up to the watermark, and
    ``unit_risk`` of it equals the batch roll-up of those rows. Rows later than that are dropped, and so are repeats
    of a position. ``idle_h`` hours after its last row, a unit's state goes; rows after that start a new trailing
    mean. Without it, an open block keeps ``rollup_rows`` scores. A row without position, or with no clock or a
    negative one, fails.
    """
    if idle_h is not None and idle_h <= 0:
        raise ValueError("idle_h is a positive number of hours")
    bad = F.raise_error(F.lit(f"{spec.clock} is NULL or negative in some row")).cast("timestamp")
    at = event_time(spec) + F.expr("INTERVAL 1 MILLISECOND")  # a watermark starts at 0 and drops what is not past it
    timed = stream.select(
        F.col(spec.unit).cast("bigint").alias(spec.unit),
        *[c for c in {spec.time, spec.position} if c is not None],
        F.col(score).cast("double").alias("score"),
        F.when(F.col(spec.clock) >= 0, at).otherwise(bad).alias("at"),
    ).withWatermark("at", f"{lateness_h} hours")
    blocks = in_blocks(timed, spec, behind=spec.rollup_rows)
    keep = _InOrder(spec.rollup_rows, spec.block_rows, None if idle_h is None else idle_h * _HOUR_MS)
    risks = (
        blocks.select(  # names without an underscore in front, which do not reach the processor
            spec.unit,
            F.col(BLOCK).alias("block"),
            F.col(POSITION).alias("position"),
            "score",
            "at",
            F.unix_millis("at").alias("at_ms"),
        )
        .groupBy(spec.unit, "block")
        .transformWithStateInPandas(keep, _RISK, "append", "EventTime")
    )
    with _state_on_disk(stream.sparkSession):
        return _to_files(risks, out_path, checkpoint)

"""Causal per-unit windows. Every frame counts rows of one unit, present or NULL, up to this row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.functions.scalars import highest
from fleetwise.operators.blocks import (
    BLOCK,
    POSITION,
    block_window,
    carried_max,
    in_blocks,
    over_frames,
    own_rows,
)
from fleetwise.operators.projection import assert_no_leakage, require_columns
from fleetwise.spec import (
    DEFAULT,
    DRIFT_SHARE_OF_STEPS,
    DRIFT_WINDOW,
    STUCK_MIN_RUN,
    TelemetrySpec,
)

STATS = ("mean", "std", "slope", "delta")


def _keys(df: DataFrame, spec: TelemetrySpec, keep: Sequence[str]) -> DataFrame:
    """The key, the wanted pass-through columns and the signals; the rest is pruned early."""
    require_columns(df, [spec.unit, spec.time, *spec.signals], "windows")
    extra = [c for c in keep if c not in (*spec.key, *spec.signals)]
    return df.select(*spec.key, *extra, *spec.signals)


def _frame_sum(x: np.ndarray, there: np.ndarray, place: np.ndarray, rows: int, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the present values of each row's frame, the oldest first; of squares about ``less`` if given."""
    total, n = np.zeros(x.shape), np.zeros(x.shape, np.int32)
    for back in range(min(rows, len(x)) - 1, -1, -1):
        end = len(x) - back
        inside = there[:end] & (place[back:] >= back)[:, None]
        v = x[:end] if less is None else (x[:end] - less[back:]) ** 2
        np.add(total[back:], v, out=total[back:], where=inside)
        n[back:] += inside
    return total, n


def frame_stats(kinds: Sequence[str], x: np.ndarray, there: np.ndarray, place: np.ndarray, rows: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Statistics of ``STATS`` for the last ``rows`` rows up to each row, and where each is absent."""

    def moved(ago: int) -> tuple[np.ndarray, np.ndarray]:
        move, both = np.zeros(x.shape), np.zeros(x.shape, bool)
        move[ago:] = x[ago:] - x[: len(x) - ago]
        both[ago:] = there[ago:] & there[: len(x) - ago] & (place[ago:] >= ago)[:, None]
        return move, both

    out = {}
    with np.errstate(all="ignore"):
        if {"mean", "std"} & set(kinds):
            total, n = _frame_sum(x, there, place, rows)
            out["mean"] = total / n, n < 2
        if "std" in kinds:
            out["std"] = np.sqrt(_frame_sum(x, there, place, rows, out["mean"][0])[0] / (n - 1)), n < 2
        if "slope" in kinds:
            total, n = _frame_sum(*moved(1), place, rows)
            out["slope"] = total / n, n < 1
        if "delta" in kinds:
            move, both = moved(rows - 1)
            out["delta"] = move, ~both
    return out


def temporal_features(
    df: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    stats: Sequence[str] = STATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The signals plus trailing mean, sample deviation, mean step and net move of each.

    Mean and deviation need two present values, the mean step one present step. All of them share
    one partitioning and one sort.
    """
    taken = _keys(df, spec, keep)
    rows, signals, wanted = spec.window_rows, list(spec.signals), list(stats)

    def made(values: dict[str, np.ma.MaskedArray], place: np.ndarray) -> list[pa.Array]:
        x = np.column_stack([values[s].data for s in signals])
        there = ~np.column_stack([np.ma.getmaskarray(values[s]) for s in signals])
        found = frame_stats(wanted, x, there, place, rows)
        return [pa.array(v[:, j], mask=absent[:, j]) for j in range(len(signals)) for v, absent in (found[k] for k in wanted)]

    fields = [T.StructField(f"{s}__{k}", T.DoubleType()) for s in signals for k in wanted]
    out = over_frames(taken, spec, rows, made, fields)
    kinds = {f"{s}__delta": taken.schema[s].dataType for s in signals if "delta" in wanted}
    out = out.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if not isinstance(t, T.DoubleType)})
    assert_no_leakage([c for c in out.columns if c not in keep], spec)
    return out


def temporal_columns(spec: TelemetrySpec = DEFAULT, stats: Sequence[str] = STATS) -> list[str]:
    return [*spec.signals, *[f"{s}__{k}" for s in spec.signals for k in stats]]


def trailing_mean(
    df: DataFrame, column: str, rows: int, out: str, spec: TelemetrySpec = DEFAULT
) -> DataFrame:
    """Mean of the last ``rows`` rows of the unit, from the first row on."""
    blocks = in_blocks(df, spec, behind=rows)
    frame = block_window(spec).rowsBetween(-(rows - 1), 0)
    return own_rows(blocks.select("*", F.avg(column).over(frame).alias(out)), spec)


def shape_flags(
    df: DataFrame,
    stuck: Sequence[str],
    monotone: Sequence[str],
    spec: TelemetrySpec = DEFAULT,
    *,
    keep: Sequence[str] = (),
    min_run: int = STUCK_MIN_RUN,
    steps: int = DRIFT_WINDOW,
    share: float = DRIFT_SHARE_OF_STEPS,
) -> DataFrame:
    """Per row and signal: equal to the previous row, in a stuck block, at the end of a creep.

    ``<s>__repeat`` is 1 when the value equals the one before. ``<s>__stuck`` is 1 on every row of
    a block of at least ``min_run`` + 1 equal values. ``<s>__monotone`` is 1 when the last
    ``steps`` steps are present and all but a few have the same sign.
    """
    blocks = in_blocks(
        _keys(df, spec, keep), spec, behind=max(2 * min_run, steps) + 1, ahead=min_run + 1
    )
    w = block_window(spec)
    used = [s for s in spec.signals if s in set(stuck) | set(monotone)]
    blocks = blocks.select("*", *[F.lag(s).over(w).alias(f"_prev_{s}") for s in used])
    blocks = blocks.select(
        "*",
        *[
            F.when(F.col(s) == F.col(f"_prev_{s}"), 1).otherwise(0).alias(f"{s}__repeat")
            for s in stuck
        ],
        *[F.signum(F.col(s) - F.col(f"_prev_{s}")).alias(f"_sign_{s}") for s in monotone],
    )
    run = w.rowsBetween(-(min_run - 1), 0)
    creep = w.rowsBetween(-(steps - 1), 0)
    blocks = blocks.select(
        "*",
        *[
            F.when(F.sum(f"{s}__repeat").over(run) == min_run, 1).otherwise(0).alias(f"_full_{s}")
            for s in stuck
        ],
        *[
            F.when(
                (F.count(f"_sign_{s}").over(creep) == steps)
                & (F.abs(F.sum(f"_sign_{s}").over(creep)) >= share * steps),
                1,
            )
            .otherwise(0)
            .alias(f"{s}__monotone")
            for s in monotone
        ],
    )
    reach = w.rowsBetween(0, min_run)
    blocks = blocks.select(
        "*", *[F.max(f"_full_{s}").over(reach).alias(f"{s}__stuck") for s in stuck]
    )
    return own_rows(blocks, spec).select(
        *spec.key,
        *[c for c in keep if c not in spec.key],
        *[f"{s}__repeat" for s in stuck],
        *[f"{s}__stuck" for s in stuck],
        *[f"{s}__monotone" for s in monotone],
    )


def equal_run(df: DataFrame, spec: TelemetrySpec = DEFAULT, *, keep: Sequence[str] = ()) -> DataFrame:
    """Per row and signal: how many rows up to this one repeat their predecessor.

    A run may be as long as the unit, so the position of its last reset is carried from block to
    block instead of being looked up in a frame.
    """
    w = block_window(spec)
    blocks = in_blocks(_keys(df, spec, keep), spec, behind=1)
    blocks = blocks.select("*", *[F.lag(s).over(w).alias(f"_prev_{s}") for s in spec.signals])
    resets = [
        F.when(F.coalesce(F.col(s) == F.col(f"_prev_{s}"), F.lit(False)), None)
        .otherwise(F.col(POSITION))
        .alias(f"{s}__run")
        for s in spec.signals
    ]
    extra = [c for c in keep if c not in (*spec.key, *spec.signals)]
    marked = own_rows(blocks, spec, keep_place=True).select(
        *spec.key, *extra, BLOCK, POSITION, *resets
    )
    done = carried_max(marked, spec, [f"{s}__run" for s in spec.signals])
    return done.select(
        *spec.key,
        *extra,
        *[(F.col(POSITION) - F.col(f"{s}__run")).cast("int").alias(f"{s}__run") for s in spec.signals],
    )


def window_tensor(
    df: DataFrame,
    centre: dict[str, float],
    scale: dict[str, float],
    spec: TelemetrySpec = DEFAULT,
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Last rows of the unit per signal: ``<s>__values`` standardised and ``<s>__present``.

    Both arrays have ``window_rows`` entries, oldest first. Rows before the unit's first and missing
    values are 0 in both.
    """
    rows, signals = spec.window_rows, list(spec.signals)
    extra = [c for c in keep if c not in (*spec.key, *spec.signals)]

    def made(values: dict[str, np.ma.MaskedArray], place: np.ndarray) -> list[pa.Array]:
        inside = place[:, None] >= np.arange(rows - 1, -1, -1)
        ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * rows)

        def lists(x: np.ndarray) -> pa.Array:
            held = sliding_window_view(np.append(np.zeros(rows - 1), x), rows)
            return pa.ListArray.from_arrays(ends, pa.array(np.where(inside, held, 0.0).ravel()))

        out = []
        with np.errstate(all="ignore"):
            for s in signals:
                absent = np.ma.getmaskarray(values[s])
                out += [lists(np.where(absent, 0.0, (values[s].data - centre[s]) / scale[s])), lists(np.where(absent, 0.0, 1.0))]
        return out

    fields = [T.StructField(f"{s}__{name}", T.ArrayType(T.DoubleType())) for s in signals for name in ("values", "present")]
    out = over_frames(_keys(df, spec, keep), spec, rows, made, fields)
    return out.select(*spec.key, *extra, *[f.name for f in fields])


def smallest_step(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> float:
    """Smallest positive time step inside any unit; 1 when there is none."""
    blocks = in_blocks(df.select(*dict.fromkeys([*spec.key, spec.clock])), spec, behind=1)
    step = F.col(spec.clock) - F.lag(spec.clock).over(block_window(spec))
    steps = own_rows(blocks.withColumn("step", step), spec).filter(F.col("step") > 0)
    return steps.agg(F.coalesce(F.min("step"), F.lit(1.0))).first()[0]


def event_times(df: DataFrame, step: float, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Per failing unit: one step past its last positive row. Assumes one event per unit."""
    return (
        df.filter(F.col(spec.target) == 1)
        .groupBy(spec.unit)
        .agg((F.max(spec.clock) + F.lit(step)).alias("event_time"))
    )


def time_to_failure(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, *, step: float | None = None
) -> DataFrame:
    """Add ``event_time`` and ``time_to_failure_h`` (infinite on negative rows). Labels only.

    The unit's event is joined as a small table built with partial aggregation, so a long unit is
    never gathered.
    """
    require_columns(df, [spec.target, spec.unit, spec.clock], "time_to_failure")
    step = smallest_step(df, spec) if step is None else step
    joined = df.join(event_times(df, step, spec), spec.unit, "left")
    left = F.when(
        F.col(spec.target) == 1, F.col("event_time") - F.col(spec.clock)
    ).otherwise(F.lit(float("inf")))
    return joined.withColumn("time_to_failure_h", left)


def any_flag(columns: Sequence[str]) -> Column:
    return highest([F.col(c) for c in columns], 0).cast("double")


def unit_rank(df: DataFrame, by: str) -> DataFrame:
    """Rank of each unit's row by ``by``, highest first; ties share a rank. For per-unit tables."""
    from fleetwise.operators.ordered import running_totals

    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    places = running_totals(counts, [], by, ["n"], descending=True)
    places = places.select(by, (F.col("cum_n") - F.col("n") + 1).alias("rank"))
    return df.join(places, by)


__all__ = [
    "STATS",
    "any_flag",
    "equal_run",
    "event_times",
    "shape_flags",
    "smallest_step",
    "temporal_columns",
    "temporal_features",
    "time_to_failure",
    "trailing_mean",
    "unit_rank",
    "window_tensor",
]

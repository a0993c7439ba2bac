"""Per-unit row frames cut into blocks of bounded size.

A window partitioned by unit alone would send a whole unit to one task. A row frame only needs a
few neighbours, so a unit is cut every ``block_rows`` positions and the rows near a cut are also
sent to the neighbouring block. A block never holds more than ``block_rows`` + neighbours rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.operators.ordered import best_before, rank_within
from fleetwise.spec import TelemetrySpec

BLOCK = "_block"
POSITION = "_position"
_GAP = "does not count 0, 1, 2, ... in every unit: name no position, and the rows are numbered first"


def numbered(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Add a gapless row number per unit when the table has none."""
    if spec.position is not None:
        absent = F.raise_error(F.lit(f"{spec.position} is NULL in some row")).cast("bigint")
        return df.withColumn(POSITION, F.coalesce(F.col(spec.position).cast("bigint"), absent))
    return rank_within(df, [spec.unit], [spec.time], POSITION)


def home_block(spec: TelemetrySpec) -> Column:
    return F.expr(f"{POSITION} div {spec.block_rows}")


def in_blocks(df: DataFrame, spec: TelemetrySpec, *, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Send every row to its block, and to a neighbour that needs it as context."""
    size = spec.block_rows
    if behind >= size or ahead >= size:
        raise ValueError(f"a frame of {behind}+{ahead} rows does not fit blocks of {size}")
    df = numbered(df, spec)
    home, spot = home_block(spec), F.pmod(F.col(POSITION), F.lit(size))
    if not behind and not ahead:
        return df.withColumn(BLOCK, home)
    last = F.when(spot >= size - behind, home + 1).otherwise(home)
    first = F.when((spot < ahead) & (home > 0), home - 1).otherwise(home)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last, F.lit(1).cast("bigint"))))


def block_window(spec: TelemetrySpec) -> WindowSpec:
    return Window.partitionBy(spec.unit, BLOCK).orderBy(POSITION)


def own_rows(df: DataFrame, spec: TelemetrySpec, *, keep_place: bool = False) -> DataFrame:
    """Drop the context rows again, and fail if a named position column turns out to have gaps.

    Every row but a unit's first must follow its predecessor. That is seen in the same sorted block,
    so the promise costs no pass of its own.
    """
    own = F.col(BLOCK) == home_block(spec)
    if spec.position is not None:
        df = df.withColumn("_before", F.lag(POSITION).over(block_window(spec)))
        follows = (F.col(POSITION) == 0) | (F.col("_before") == F.col(POSITION) - 1)
        gap = F.raise_error(F.lit(f"{spec.position} {_GAP}")).cast("boolean")
        own = own & F.when(F.coalesce(follows, F.lit(False)), True).otherwise(gap)
    kept = df.filter(own).drop("_before")
    return kept if keep_place else kept.drop(BLOCK, POSITION)


def over_frames(
    df: DataFrame,
    spec: TelemetrySpec,
    behind: int,
    made: Callable[[dict[str, np.ndarray], np.ndarray], list[pa.Array]],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """``df`` with the columns ``fields``, which ``made`` works out for many rows at a time.

    Spark deals out the blocks and sorts each by position. ``made`` gets the signals as doubles in the order
    of the rows, a missing one as a masked array, and every row's place in its block, so that the frame of a
    row ends at its first place. Gaps are found as in ``own_rows``.
    """
    blocks = in_blocks(df, spec, behind=behind)
    group = F.xxhash64(F.col(spec.unit), F.col(spec.unit).isNull(), F.col(BLOCK))
    laid = blocks.repartition(spec.unit, BLOCK).sortWithinPartitions(spec.unit, BLOCK, POSITION)
    laid = laid.select(*df.columns, POSITION, (F.col(BLOCK) == home_block(spec)).alias("_own"), group.alias("_group"))
    gapless, signals, names = spec.position is not None, list(spec.signals), list(df.columns)
    gap = f"{spec.position} {_GAP}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = held.num_rows if held is not None else 0
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = rows.slice(max(0, rows.num_rows - behind))
            group, at = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_group", POSITION))
            row = np.arange(len(at))
            place = row - np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), row, 0))
            own = rows.column("_own").to_numpy(zero_copy_only=False).copy()
            own[:old] = False
            if gapless and (own & (at != 0) & ((place == 0) | (np.append(0, at[:-1]) != at - 1))).any():
                raise ValueError(gap)
            values = {}
            for s in signals:
                c = rows.column(s)
                x = c.fill_null(0).to_numpy(zero_copy_only=False).astype("float64")
                values[s] = np.ma.masked_array(x, c.is_null().to_numpy(zero_copy_only=False))
            whole = pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in names], *made(values, place)], [*names, *[f.name for f in fields]]
            )
            yield whole.filter(pa.array(own))

    return laid.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def carried_max(df: DataFrame, spec: TelemetrySpec, marks: Sequence[str]) -> DataFrame:
    """Replace each mark by its running maximum over the unit's whole past.

    ``df`` must already be in blocks without context rows. The maximum runs inside every block; the
    maxima of earlier blocks come from one small row per block.
    """
    upto = block_window(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = df.groupBy(spec.unit, BLOCK).agg(*[F.max(m).alias(m) for m in marks])
    carried = best_before(tops, [spec.unit], BLOCK, {f"_carried_{m}": m for m in marks}).drop(*marks)
    rest = [c for c in df.columns if c not in marks]
    return df.join(carried, [spec.unit, BLOCK]).select(
        *rest,
        *[F.greatest(F.max(m).over(upto), F.col(f"_carried_{m}")).alias(m) for m in marks],
    )

"""Ranks and running totals over any number of rows, without a one-task window.

Both start from a range partitioning on the full sort key, which splits a group of any size at
row granularity. Each partition is then numbered or summed alone, and the few partition totals
give every partition its starting point. The windows over those totals see one row per partition (and group),
also when there is no group to partition them by.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwise.shared import stored

_PART, _AT, _GROUP, _HEAD = "_part", "_at", "_group", "_head"


def _with_parts(laid: DataFrame, parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join what is known of every partition (and group) to its rows; a NULL group is a group."""
    keys = [*groups, _PART]
    named = parts.withColumnsRenamed({k: f"_of{k}" for k in keys})
    same = reduce(and_, [laid[k].eqNullSafe(named[f"_of{k}"]) for k in keys])
    return laid.join(named, same)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to the sorted rows of a partition, whose last column tells the groups apart, the row's place in its
    group and whether the group is the partition's first."""
    last, seen, head = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        row = np.arange(len(group))
        fresh = np.append(last is not None and group[0] != last, group[1:] != group[:-1])
        begins = np.maximum.accumulate(np.where(fresh, row, -1))
        place = np.where(begins < 0, row + seen, row - begins)
        first = (begins < 0) & head
        head, last, seen = bool(first[-1]), group[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(first)], [*batch.schema.names, _AT, _HEAD])


def rank_within(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    start: int = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Number the rows of every group in ``order`` (a unique key within the group).

    ``keep`` names the columns wanted afterwards, by default all. The rows are shuffled once: a partition's
    sorted rows are counted as they are written, and only its first group can have begun in an earlier
    partition, so the driver adds up one number per partition.
    """
    keep = list(df.columns if keep is None else keep)
    # tells neighbours apart, NULL from NULL in another column too
    group = F.xxhash64(*groups, *[F.col(g).isNull() for g in groups]) if groups else F.lit(0).cast("bigint")
    rows = (
        df.repartitionByRange(*groups, *order)
        .sortWithinPartitions(*groups, *order)
        .select(*keep, F.spark_partition_id().alias(_PART), group.alias(_GROUP))
    )
    places = [T.StructField(_AT, T.LongType()), T.StructField(_HEAD, T.BooleanType())]
    laid = stored(rows.mapInArrow(_counted, T.StructType([*rows.schema.fields, *places])), "ranked")
    heads = {r[_PART]: r[_GROUP] for r in laid.filter(_HEAD).groupBy(_PART).agg(F.min(_GROUP).alias(_GROUP)).collect()}
    ends = laid.filter(F.col(_GROUP).isin(sorted(set(heads.values())))).groupBy(_PART, _GROUP).count().collect()
    shifts = [start] * (max(heads, default=0) + 1)
    for p, g in heads.items():
        shifts[p] += sum(r["count"] for r in ends if r[_GROUP] == g and r[_PART] < p)
    shift = F.when(F.col(_HEAD), F.lit(shifts)[F.col(_PART)]).otherwise(start)
    return laid.select(*keep, (F.col(_AT) + shift).cast("bigint").alias(out))


def running_totals(
    counts: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<m>`` (up to and with this value), ``all_<m>`` and ``next_value`` per group.

    ``counts`` holds one row per group and value, so that the shuffle carries counts, not rows.
    ``next_value`` follows the direction of the running total.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    laid = stored(
        counts.repartitionByRange(*groups, way(value)).withColumn(_PART, F.spark_partition_id()),
        "totals",
    )
    edge = F.max(value) if descending else F.min(value)
    parts = laid.groupBy(*groups, _PART).agg(
        *[F.sum(m).alias(f"_sum_{m}") for m in measures], edge.alias("_edge")
    )
    by_part = Window.partitionBy(*groups).orderBy(_PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = parts.select(
        *groups,
        _PART,
        F.lead("_edge").over(by_part).alias("_next_edge"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_from_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = Window.partitionBy(*groups, _PART).orderBy(way(value))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_parts(laid, starts, groups).select(
        *counts.columns,
        F.coalesce(F.lead(value).over(inside), F.col("_next_edge")).alias("next_value"),
        *[(F.col(f"_from_{m}") + F.sum(m).over(upto)).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )


def best_before(
    rows: DataFrame, groups: Sequence[str], value: str, states: Mapping[str, str]
) -> DataFrame:
    """For each ``out: state``, the largest state among the group's rows before this one.

    ``value`` is unique within the group and gives the order; the first row gets NULL.
    """
    laid = stored(
        rows.repartitionByRange(*groups, value).withColumn(_PART, F.spark_partition_id()), "best"
    )
    parts = laid.groupBy(*groups, _PART).agg(*[F.max(s).alias(f"_top_{s}") for s in states.values()])
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.select(
        *groups, _PART, *[F.max(f"_top_{s}").over(earlier).alias(f"_from_{s}") for s in states.values()]
    )
    before = Window.partitionBy(*groups, _PART).orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return _with_parts(laid, tops, groups).select(
        *rows.columns,
        *[
            F.greatest(F.max(s).over(before), F.col(f"_from_{s}")).alias(out)
            for out, s in states.items()
        ],
    )


def quantiles_within(counts: DataFrame, groups: Sequence[str], value: str, q: float) -> DataFrame:
    """Exact interpolated quantile per group of a table of (group, value, n) counts."""
    run = running_totals(counts, groups, value, ["n"])
    place = (F.col("all_n") - 1) * F.lit(float(q))
    low, high = F.floor(place), F.ceil(place)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    picked = run.filter(((low >= first) & (low <= last)) | ((high >= first) & (high <= last)))
    at_low = F.max(F.when((low >= first) & (low <= last), F.col(value)))
    at_high = F.max(F.when((high >= first) & (high <= last), F.col(value)))
    share = F.max(place - low)
    return picked.groupBy(*groups).agg((at_low + (at_high - at_low) * share).alias("quantile"))

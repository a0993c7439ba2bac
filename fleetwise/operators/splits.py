"""Whole-unit splits, folds and stratified picks, all seeded by a hash of the unit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwise.operators.ordered import rank_within, running_totals
from fleetwise.spec import DEFAULT, FAILURE_MODES, FOLDS, SEED, TEST_SHARE, TelemetrySpec


def unit_draw(spec: TelemetrySpec = DEFAULT, seed: int = SEED) -> Column:
    """A reproducible random draw per unit, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(spec.unit).cast("string")))


def units_of(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    return df.groupBy(spec.unit).agg(F.count(F.lit(1)).alias("n_rows"))


def unit_sides(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, *, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Every unit with its side: the lowest draws go to the test side."""
    drawn = df.select(spec.unit).distinct().withColumn("_draw", unit_draw(spec, seed))
    counts = drawn.withColumn("n", F.lit(1).cast("bigint"))
    placed = running_totals(counts, [], "_draw", ["n"])
    side = F.when(F.col("cum_n") <= F.ceil(F.col("all_n") * F.lit(share)), "test").otherwise("train")
    return placed.select(spec.unit, side.alias("split"))


def grouped_split(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, *, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``; a unit is never on both sides."""
    return df.join(unit_sides(df, spec, share=share, seed=seed), spec.unit)


def fold_units(df: DataFrame, spec: TelemetrySpec = DEFAULT, *, folds: int = FOLDS) -> DataFrame:
    """Every unit with its fold: largest units first, dealt out back and forth."""
    sized = units_of(df, spec).withColumn("_minus", -F.col("n_rows"))
    placed = rank_within(sized, [], ["_minus", spec.unit], "_place")
    turn = F.pmod(F.col("_place"), F.lit(2 * folds))
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return placed.select(spec.unit, "n_rows", fold.cast("int").alias("fold"))


def grouped_folds(df: DataFrame, spec: TelemetrySpec = DEFAULT, *, folds: int = FOLDS) -> DataFrame:
    """Add ``fold``. With fewer units than folds every unit is a fold of its own."""
    return df.join(fold_units(df, spec, folds=folds).drop("n_rows"), spec.unit)


def split_profile(df: DataFrame, spec: TelemetrySpec = DEFAULT, by: str = "split") -> DataFrame:
    """Rows, units and classes per side, from per-unit counts."""
    per_unit = df.groupBy(by, spec.unit).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(spec.target).alias("pos"),
    )
    classes = (F.sum("pos") > 0).cast("int") + (F.sum("n") > F.sum("pos")).cast("int")
    return per_unit.groupBy(by).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("pos").alias("n_positive"),
        classes.alias("n_classes"),
    )


def split_overlap(df: DataFrame, spec: TelemetrySpec = DEFAULT, by: str = "split") -> DataFrame:
    """Units found on both sides; must be empty."""
    side = lambda name: df.filter(F.col(by) == name).select(spec.unit)
    return side("train").intersect(side("test"))


def unit_event_mode(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """The failure mode of every unit, '' for one that never fails."""
    mode = F.max(F.when(F.col(spec.target) == 1, F.col(spec.mode)))
    return df.groupBy(spec.unit).agg(F.coalesce(mode, F.lit("")).alias("event_mode"))


class MissingMode(RuntimeError):
    """A failure mode has no positive row, or a stratum has too few units."""


def mode_coverage(
    df: DataFrame, spec: TelemetrySpec = DEFAULT, *, strict: bool = False
) -> DataFrame:
    """Positive rows of every expected failure mode."""
    hits = df.filter(F.col(spec.target) == 1).agg(
        *[F.count_if(F.col(spec.mode) == m).alias(m) for m in FAILURE_MODES]
    )
    entries = [
        F.struct(
            F.lit(m).alias("mode"), F.col(m).alias("n_positive"), (F.col(m) > 0).alias("covered")
        )
        for m in FAILURE_MODES
    ]
    out = hits.select(F.inline(F.array(*entries)))
    if strict:
        absent = [r["mode"] for r in out.filter(~F.col("covered")).collect()]
        if absent:
            raise MissingMode(f"no positive row for {absent}")
    return out


# Units kept per failure mode, and of those that never fail.
QUOTAS = {"overheat": 8, "oil_starve": 8, "bearing": 8, "": 10}


def stratified_units(
    modes: DataFrame,
    unit_class: DataFrame,
    class_name: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    quotas: Mapping[str, int] = QUOTAS,
    seed: int = SEED,
    strict: bool = True,
) -> DataFrame:
    """A quota of units per failure mode, dealt over the unit classes in turn.

    No class can supply more than the quota, so each is cut to its first draws before the modes
    are dealt; the cut runs before the shuffle.
    """
    most = max(quotas.values())
    quota = F.coalesce(
        *[F.when(F.col("event_mode") == m, F.lit(k)) for m, k in quotas.items()], F.lit(0)
    )
    pool = modes.join(unit_class, spec.unit, "left").withColumn("_draw", unit_draw(spec, seed))
    in_class = Window.partitionBy("event_mode", class_name).orderBy("_draw")
    pool = pool.withColumn("turn", F.row_number().over(in_class)).filter(F.col("turn") <= most)
    in_mode = Window.partitionBy("event_mode").orderBy("turn", class_name)
    picked = pool.withColumn("place", F.row_number().over(in_mode)).filter(
        (F.col("place") <= most) & (F.col("place") <= quota)
    )
    picked = picked.select(spec.unit, "event_mode", class_name, "turn", "place")
    if strict:
        got = {r["event_mode"]: r["count"] for r in picked.groupBy("event_mode").count().collect()}
        short = {m: got.get(m, 0) for m, k in quotas.items() if m and got.get(m, 0) < k}
        if short:
            raise MissingMode(f"too few units: {short} of {dict(quotas)}")
    return picked

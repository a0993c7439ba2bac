"""Exact ranking metrics from grouped score counts.

Rows are first counted per distinct score, so only counts are sorted, and all metrics of all
slices come from running totals over that one table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.functions.scalars import total
from fleetwise.operators.ordered import running_totals
from fleetwise.spec import (
    ALARM_BUDGET,
    DEFAULT,
    FAMILIES,
    HIGH_RISK,
    HORIZON_EDGES_H,
    OVERFIT_GAP,
    SUBTLE_FAMILIES,
    TRIVIAL_AUC,
    TRIVIAL_MARGIN,
    TelemetrySpec,
)

BINS = 10


class DegenerateSplit(RuntimeError):
    """A metric is undefined because only one class is present."""


def _count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def graded(df: DataFrame, score: str) -> DataFrame:
    """``df``, which fails when a score is NaN: NaN sorts above all numbers and would alarm first."""
    if df.schema[score].dataType.typeName() not in ("double", "float"):
        return df
    bad = F.raise_error(F.lit(f"{score} is NaN in some row")).cast(df.schema[score].dataType)
    return df.withColumn(score, F.when(F.isnan(score), bad).otherwise(F.col(score)))


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return graded(df, score).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), _count_where(F.col(label).cast("int") == 1).alias("pos")
    )


def _auc(pos: str, neg: str, cum_neg: str, all_neg: str | None = None) -> Column:
    """Mann-Whitney over ascending scores; ties count half. NULL when a class is absent."""
    wins = F.sum(F.col(pos) * (F.col(cum_neg) - F.col(neg) / F.lit(2.0)))
    negatives = F.max(all_neg) if all_neg else F.sum(neg)
    pairs = F.sum(pos).cast("double") * negatives
    return F.when(pairs > 0, wins / pairs)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and exact AUC, per ``by`` group."""
    return auc_from(score_counts(df, score, label, by), score, by)


def auc_from(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` of counts (``by``, score, n, pos), one row per group and score."""
    counts = counts.select(*by, score, "n", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    run = running_totals(counts, by, score, ["neg"])
    return run.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_positive"),
        _auc("pos", "neg", "cum_neg").alias("roc_auc"),
    )


def auc_of(df: DataFrame, score: str, label: str, *, strict: bool = False) -> float | None:
    """One AUC as a number, for decisions taken on the driver."""
    value = roc_auc(df, score, label).first()["roc_auc"]
    if value is None and strict:
        raise DegenerateSplit("only one class is present; the AUC is undefined")
    return value


def _descending(counts: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    return running_totals(counts, by, score, ["n", "pos"], descending=True)


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at every distinct threshold, weighted by the recall it adds."""
    return precision_from(score_counts(df, score, label, by), score, by)


def precision_from(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    run = _descending(counts, score, by)
    gain = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n").cast("double"))
    return run.groupBy(*by).agg(
        F.when(F.sum("pos") > 0, gain / F.sum("pos")).alias("average_precision")
    )


def threshold_sweep(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score taken as the threshold."""
    return sweep_from(score_counts(df, score, label, by), score, by)


def sweep_from(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    run = _descending(counts, score, by)
    return run.select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n").cast("double")).alias("precision"),
        F.when(F.col("all_pos") > 0, F.col("cum_pos") / F.col("all_pos").cast("double")).alias(
            "recall"
        ),
    )


def budget_rows(n: Column, budget: float) -> Column:
    """How many rows may alarm: the rounded share (half to even), at least one."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(budget)), 0)).cast("bigint")


def alarm_cut(df: DataFrame, score: str, budget: float = ALARM_BUDGET) -> float | None:
    """Lowest score that still alarms; None when even the top tie overflows the budget."""
    counts = graded(df, score).groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, [], score, ["n"], descending=True)
    return run.filter(F.col("cum_n") <= budget_rows(F.col("all_n"), budget)).agg(F.min(score)).first()[0]


def alarm_set(df: DataFrame, score: str, budget: float = ALARM_BUDGET) -> DataFrame:
    """The rows inside the alarm budget; a tie that crosses it is left out whole."""
    cut = alarm_cut(df, score, budget)
    return df.filter(F.lit(False) if cut is None else F.col(score) >= F.lit(cut))


def ladder_grades(
    scores: DataFrame,
    score: str = "score",
    by: str = "detector",
    spec: TelemetrySpec = DEFAULT,
    *,
    families: Sequence[str] = FAMILIES,
    budget: float = ALARM_BUDGET,
) -> DataFrame:
    """AUC, AP and recall per anomaly family inside the alarm budget, per detector, in one pass.

    A recall is NULL when the family is absent.
    """
    counts = scores.groupBy(by, score).agg(
        F.count(F.lit(1)).alias("n"),
        _count_where(F.col(spec.outlier)).alias("pos"),
        *[_count_where(F.col(spec.family) == f).alias(f"fam_{f}") for f in families],
    )
    run = running_totals(counts, [by], score, ["n", "pos"], descending=True)
    above_neg = F.col("cum_n") - F.col("n") - (F.col("cum_pos") - F.col("pos"))
    below_neg = (F.col("all_n") - F.col("all_pos")) - above_neg - (F.col("n") - F.col("pos")) / 2.0
    pairs = F.max("all_pos").cast("double") * (F.max("all_n") - F.max("all_pos"))
    inside = F.col("cum_n") <= budget_rows(F.col("all_n"), budget)
    grades = run.groupBy(by).agg(
        F.sum("n").alias("n_rows"),
        F.when(pairs > 0, F.sum(F.col("pos") * below_neg) / pairs).alias("roc_auc"),
        F.when(
            F.max("all_pos") > 0,
            F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n").cast("double")) / F.max("all_pos"),
        ).alias("average_precision"),
        *[
            F.when(
                F.sum(f"fam_{f}") > 0,
                F.sum(F.when(inside, F.col(f"fam_{f}")).otherwise(0))
                / F.sum(f"fam_{f}").cast("double"),
            ).alias(f"recall_{f}")
            for f in families
        ],
    )
    return grades


def subtle_recall(families: Sequence[str] = SUBTLE_FAMILIES) -> Column:
    """Mean recall over the subtle families that are present."""
    present = [F.when(F.col(f"recall_{f}").isNotNull(), 1).otherwise(0) for f in families]
    return total([F.coalesce(F.col(f"recall_{f}"), F.lit(0.0)) for f in families]) / F.nullif(
        total(present), F.lit(0)
    )


def adaptive_verdict(grades: DataFrame, adaptive: str, by: str = "detector") -> DataFrame:
    """Does the adaptive detector beat the best of the others on mean subtle recall?"""
    graded = grades.select(by, subtle_recall().alias("_subtle"))
    out = graded.agg(
        F.max(F.when(F.col(by) == adaptive, F.col("_subtle"))).alias("adaptive_subtle_recall"),
        F.max(F.when(F.col(by) != adaptive, F.col("_subtle"))).alias("best_other_subtle_recall"),
    )
    return out.select(
        "*",
        (F.col("adaptive_subtle_recall") > F.col("best_other_subtle_recall")).alias("earns_place"),
    )


def family_recall(
    df: DataFrame,
    score: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    families: Sequence[str] = FAMILIES,
    budget: float = ALARM_BUDGET,
) -> DataFrame:
    """Recall per anomaly family at the alarm budget, in long form; NULL if a family is absent."""
    counts = df.groupBy(score).agg(
        F.count(F.lit(1)).alias("n"),
        *[_count_where(F.col(spec.family) == f).alias(f) for f in families],
    )
    run = running_totals(counts, [], score, ["n"], descending=True)
    inside = F.col("cum_n") <= budget_rows(F.col("all_n"), budget)
    sums = run.agg(
        *[F.sum(f).alias(f"all_{f}") for f in families],
        *[F.sum(F.when(inside, F.col(f)).otherwise(0)).alias(f"hit_{f}") for f in families],
    )
    entries = [
        F.struct(
            F.lit(f).alias("family"),
            F.col(f"all_{f}").alias("n_rows"),
            F.col(f"hit_{f}").alias("n_alarmed"),
            F.when(
                F.col(f"all_{f}") > 0, F.col(f"hit_{f}") / F.col(f"all_{f}").cast("double")
            ).alias("recall"),
        )
        for f in families
    ]
    return sums.select(F.inline(F.array(*entries)))


def _sliced_auc(df: DataFrame, score: str, label: str, slices: Mapping[str, Column]) -> DataFrame:
    """AUC of each slice's positives against all negatives.

    Positives are counted per slice beside the one count of negatives, so no negative is copied.
    """
    names = list(slices)
    positive = F.col(label).cast("int") == 1
    counts = df.groupBy(score).agg(
        _count_where(~positive).alias("neg"),
        *[
            _count_where(positive & F.coalesce(slices[k], F.lit(False))).alias(f"pos_{i}")
            for i, k in enumerate(names)
        ],
    )
    run = running_totals(counts, [], score, ["neg"])
    sums = run.agg(
        F.sum("neg").alias("_neg"),
        *[F.sum(f"pos_{i}").alias(f"n_{i}") for i in range(len(names))],
        *[_auc(f"pos_{i}", "neg", "cum_neg").alias(f"auc_{i}") for i in range(len(names))],
    )
    entries = [
        F.struct(
            F.lit(k).alias("slice"),
            (F.col(f"n_{i}") + F.col("_neg")).alias("n_rows"),
            F.col(f"n_{i}").alias("n_positive"),
            F.col(f"auc_{i}").alias("roc_auc"),
        )
        for i, k in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*entries)))


def horizon_bands(edges: Sequence[float] = HORIZON_EDGES_H) -> dict[str, tuple[float, float]]:
    tops = [*edges[1:], float("inf")]
    return {f"[{low:g},{high:g}) h": (low, high) for low, high in zip(edges, tops)}


def auc_by_horizon(
    df: DataFrame, score: str, spec: TelemetrySpec = DEFAULT, ttf: str = "time_to_failure_h"
) -> DataFrame:
    slices = {
        name: (F.col(ttf) >= low) & (F.col(ttf) < high)
        for name, (low, high) in horizon_bands().items()
    }
    return _sliced_auc(df, score, spec.target, slices)


def seen_modes(df: DataFrame, spec: TelemetrySpec = DEFAULT) -> list[str]:
    """The failure modes on positive rows. A mode is a category: their number is small."""
    rows = (
        df.filter((F.col(spec.target) == 1) & (F.col(spec.mode) != ""))
        .select(spec.mode)
        .distinct()
        .collect()
    )
    return sorted(r[0] for r in rows)


def auc_by_mode(
    df: DataFrame, score: str, spec: TelemetrySpec = DEFAULT, modes: Sequence[str] | None = None
) -> DataFrame:
    modes = seen_modes(df, spec) if modes is None else list(modes)
    return _sliced_auc(df, score, spec.target, {m: F.col(spec.mode) == m for m in modes})


def bin_of(score: str, bins: int = BINS) -> Column:
    """The equal bin of a score; an upper edge belongs to the next bin."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return total([(F.col(score) >= F.lit(e)).cast("int") for e in edges])


def calibration(df: DataFrame, score: str, label: str, bins: int = BINS) -> DataFrame:
    """Mean prediction, observed rate and count per equal bin; empty bins are absent."""
    return (
        df.groupBy(bin_of(score, bins).alias("bin"))
        .agg(
            F.avg(score).alias("mean_predicted"),
            F.avg(F.col(label).cast("double")).alias("observed_rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def batch_summary(df: DataFrame, score: str, threshold: float = HIGH_RISK) -> DataFrame:
    """High-risk count and share, with a histogram of ten bins that shows empty bins as 0."""
    place = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1))
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(score) >= threshold).alias("n_high_risk"),
        *[F.count_if(place == i).alias(f"bin_{i}") for i in range(BINS)],
    )
    share = F.when(F.col("n_rows") > 0, F.col("n_high_risk") * 100.0 / F.col("n_rows")).otherwise(
        F.lit(0.0)
    )
    entries = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(i / BINS).alias("bin_low"),
            F.lit((i + 1) / BINS).alias("bin_high"),
            F.col(f"bin_{i}").alias("n"),
        )
        for i in range(BINS)
    ]
    return sums.select(
        "n_rows", "n_high_risk", share.alias("pct_high_risk"), F.inline(F.array(*entries))
    )


class FitAudit(RuntimeError):
    """A fit that overfits or does not beat the trivial model."""


def audit_fit(aucs: DataFrame, *, strict: bool = False) -> DataFrame:
    """Verdict on rows of (train_auc, cv_auc, test_auc)."""
    gap = F.col("train_auc") - F.col("cv_auc")
    over = gap > OVERFIT_GAP
    lift = F.col("test_auc") > TRIVIAL_AUC + TRIVIAL_MARGIN
    out = aucs.select(
        "*",
        gap.alias("overfit_gap"),
        over.alias("overfit_tripped"),
        lift.alias("beats_majority"),
        (over | ~lift).alias("tripped"),
    )
    if strict and not out.filter("tripped").isEmpty():
        raise FitAudit(str(out.filter("tripped").first().asDict()))
    return out

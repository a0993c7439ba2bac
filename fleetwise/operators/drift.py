"""Distribution distance between two batches, for all signals in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.functions.scalars import total
from fleetwise.operators.aggregates import moments_table
from fleetwise.operators.ordered import running_totals
from fleetwise.operators.projection import select_features
from fleetwise.spec import DEFAULT, DRIFTED_SHARE, TelemetrySpec

# The cuts of the two tests.
P_VALUE_CUT = 0.05
DISTANCE_CUT = 0.1
SCALE_FLOOR = 0.001
SERIES_TERMS = 20


def value_counts(reference: DataFrame, current: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """(signal, value, n_ref, n_cur) of both batches."""

    def side(df: DataFrame, is_ref: int) -> DataFrame:
        long = select_features(df, spec).unpivot([], list(spec.signals), "signal", "value")
        return long.filter(F.col("value").isNotNull()).select(
            "signal", "value", F.lit(is_ref).alias("r"), F.lit(1 - is_ref).alias("c")
        )

    both = side(reference, 1).unionByName(side(current, 0))
    return both.groupBy("signal", "value").agg(
        F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur")
    )


def _tail(lam: Column) -> Column:
    """Asymptotic Kolmogorov tail, as an alternating series."""
    terms = [
        F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
        for k in range(1, SERIES_TERMS + 1)
    ]
    # the series needs a few terms only once lam is not tiny; for a tiny lam the tail is 1
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(terms)))
    )


def distances(reference: DataFrame, current: DataFrame, spec: TelemetrySpec = DEFAULT) -> DataFrame:
    """Per signal: KS distance and p-value, Wasserstein distance and its normed form.

    A signal absent from either batch has NULL distances.
    """
    counts = value_counts(reference, current, spec)
    run = running_totals(counts, ["signal"], "value", ["n_ref", "n_cur"])
    f, g = F.col("cum_n_ref") / F.col("all_n_ref"), F.col("cum_n_cur") / F.col("all_n_cur")
    both = (F.col("all_n_ref") > 0) & (F.col("all_n_cur") > 0)
    gap = F.when(both, F.abs(f - g))
    sums = run.withColumn("_gap", gap).groupBy("signal").agg(
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_cur").alias("n_cur"),
        F.max("_gap").alias("ks"),
        F.sum(
            F.col("_gap") * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
        ).alias("wasserstein"),
    )
    spread = moments_table(reference, spec).select("signal", F.col("std_pop").alias("ref_std"))
    a, b = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    lam = F.sqrt(a * b / (a + b)) * F.col("ks")
    return sums.join(spread, "signal").select(
        "signal",
        "n_ref",
        "n_cur",
        "ks",
        F.when(F.col("ks").isNotNull(), _tail(lam)).alias("ks_p_value"),
        "wasserstein",
        "ref_std",
        (F.col("wasserstein") / F.greatest(F.col("ref_std"), F.lit(SCALE_FLOOR))).alias(
            "wasserstein_norm"
        ),
    )


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    spec: TelemetrySpec = DEFAULT,
    *,
    test: str = "wasserstein",
    p_cut: float = P_VALUE_CUT,
    distance_cut: float = DISTANCE_CUT,
) -> DataFrame:
    """Which signals have drifted, by ``test`` for batches of every size: ``wasserstein`` compares the
    normed distance with ``distance_cut``, ``ks`` the p-value with ``p_cut``. The p-value of large
    batches falls below any cut for differences that do not matter."""
    if test not in ("wasserstein", "ks"):
        raise ValueError(f"test is wasserstein or ks, not {test}")
    by_ks = test == "ks"
    flag = F.col("ks_p_value") < p_cut if by_ks else F.col("wasserstein_norm") >= distance_cut
    return distances(reference, current, spec).select(
        "*",
        F.lit(test).alias("test"),
        F.coalesce(flag, F.lit(False)).alias("drifted"),
    )


def drift_decision(
    features: DataFrame, spec: TelemetrySpec = DEFAULT, threshold: float = DRIFTED_SHARE
) -> DataFrame:
    """One row: has a large enough share of the signals drifted?"""
    n = F.lit(len(spec.signals))
    hits = features.agg(F.count_if("drifted").alias("n_drifted"))
    share = F.col("n_drifted") / n.cast("double")
    return hits.select(
        "n_drifted",
        n.alias("n_features"),
        share.alias("share_drifted"),
        F.lit(threshold).alias("threshold"),
        (share >= threshold).alias("drifted"),
    )

"""Ranks and running totals against plain pandas, with one group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwise.operators.aggregates import exact_quantiles
from fleetwise.operators.ordered import (
    best_before,
    quantiles_within,
    rank_within,
    running_totals,
)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    group = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 30, 3000))
    return pd.DataFrame(
        {"g": group, "k": rng.permutation(3000), "v": rng.integers(0, 200, 3000) / 8.0}
    )


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank(spark, skewed):
    got = rank_within(spark.createDataFrame(skewed), ["g"], ["k"], "r").toPandas()
    got = got.sort_values(["g", "k"]).reset_index(drop=True)
    want = skewed.sort_values(["g", "k"]).groupby("g").cumcount()
    assert got["r"].tolist() == want.tolist()


def test_rank_of_the_whole_table(spark, skewed):
    got = rank_within(spark.createDataFrame(skewed), [], ["k"], "r", start=1).toPandas()
    assert (got["r"] == got["k"] + 1).all()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, skewed, descending):
    counts = (
        spark.createDataFrame(skewed).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    got = running_totals(counts, ["g"], "v", ["n"], descending=descending).toPandas()
    got = got.sort_values(["g", "v"], ascending=[True, not descending]).reset_index(drop=True)
    want = skewed.groupby(["g", "v"]).size().reset_index(name="n")
    want = want.sort_values(["g", "v"], ascending=[True, not descending]).reset_index(drop=True)
    assert got["cum_n"].tolist() == want.groupby("g")["n"].cumsum().tolist()
    assert got["all_n"].tolist() == want.groupby("g")["n"].transform("sum").tolist()
    ahead = want.groupby("g")["v"].shift(-1)
    assert got["next_value"].fillna(-1).tolist() == ahead.fillna(-1).tolist()


def test_best_before(spark, skewed):
    got = best_before(spark.createDataFrame(skewed), ["g"], "k", {"b": "v"}).toPandas()
    got = got.sort_values(["g", "k"]).reset_index(drop=True)
    want = skewed.sort_values(["g", "k"])
    want = want.groupby("g")["v"].transform(lambda s: s.cummax().shift())
    assert got["b"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_quantiles_within_groups(spark, skewed):
    counts = spark.createDataFrame(skewed).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = quantiles_within(counts, ["g"], "v", 0.95).toPandas().set_index("g")["quantile"]
    want = skewed.groupby("g")["v"].quantile(0.95)
    np.testing.assert_allclose(got.sort_index(), want.sort_index(), rtol=0, atol=1e-12)


def test_exact_quantiles_skip_nulls_and_empty_columns(spark):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"a": rng.normal(size=5001), "b": rng.integers(0, 3, 5001) * 1.0})
    df.loc[::7, "a"] = None
    made = spark.createDataFrame(df).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    made = made.withColumn("c", F.lit(None).cast("double"))
    got = exact_quantiles(made, ["a", "b", "c"], 0.5)
    assert got["a"] == pytest.approx(df["a"].median(), abs=1e-15)
    assert got["b"] == df["b"].median()
    assert got["c"] is None


def test_ranks_need_no_second_shuffle_and_keep_what_is_asked_for(spark):
    rows = [(None if i % 5 == 0 else i % 3, i, -i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, rest int")
    got = rank_within(df.repartition(7), ["g"], ["k"], "r", keep=["g", "rest"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert got.columns == ["g", "rest", "r"]
    want = pd.DataFrame(rows, columns=["g", "k", "rest"]).sort_values("k")
    want["r"] = want.groupby("g", dropna=False).cumcount()
    assert [(r.rest, r.r) for r in sorted(got.collect(), key=lambda r: r.rest)] == [(a, b) for a, b in sorted(zip(want.rest, want.r))]

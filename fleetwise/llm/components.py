"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.shared import kept, scope, stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the pairs ``a``, ``b``.

    Contraction: every node is mapped to whichever of itself and its neighbours has the smallest
    hash in this round, edges follow, loops and repeats go, until no edge is left. A neighbour is
    always in the node's component, so no two components meet; images of neighbours are equal
    or neighbours, so none falls apart. The share of nodes that stay is bounded on average, hence
    a number of rounds logarithmic in the largest component. The smallest hash per node is
    combined before the shuffle, so a hub is no hot spot. Null pairs are left out.
    """
    with scope():
        edges = stored(
            edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "edges",
        )
        placed, turn = None, 0
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a")).toDF("node", "other")
            rank = F.xxhash64("other", F.lit(turn))
            best = both.groupBy("node").agg(
                F.min(rank).alias("rank"), F.min_by("other", rank).alias("other")
            )
            own = F.xxhash64("node", F.lit(turn))
            parent = stored(
                best.select("node", F.when(own < F.col("rank"), F.col("node")).otherwise(F.col("other")).alias("parent")),
                "parents",
            )
            if placed is None:
                placed = parent.toDF("node", "root")
            else:
                moved = parent.toDF("root", "parent")
                placed = stored(
                    placed.join(moved, "root", "left").select(
                        "node", F.coalesce("parent", "root").alias("root")
                    ),
                    "placed",
                )
            edges = stored(
                edges.join(parent.toDF("a", "pa"), "a")
                .join(parent.toDF("b", "pb"), "b")
                .where("pa <> pb")
                .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                .distinct(),
                "edges",
            )
            turn += 1
        if placed is None:
            return edges.selectExpr("a AS node", "a AS component").where("false").transform(lambda d: kept(d, "components"))
        lowest = placed.groupBy("root").agg(F.min("node").alias("component"))
        return kept(placed.join(lowest, "root").select("node", "component"), "components")

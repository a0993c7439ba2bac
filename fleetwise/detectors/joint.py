"""Rows whose signals are odd together: isolation trees, robust distance, linear reconstruction.

All three see median- or mean-filled signals, so a missing signal cannot raise suspicion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.detectors.starts import distance_quantile, most_compact
from fleetwise.functions.scalars import total
from fleetwise.operators.aggregates import (
    MinMax,
    fit_minmax,
    impute,
    signal_medians,
    signal_moments,
    standardised,
)
from fleetwise.spec import DEFAULT, SEED, TelemetrySpec

TREES = 200
TREE_ROWS = 256
SUPPORT = 0.9
BOTTLENECK = 4
RIDGE = 1e-6
MAX_STEPS = 100  # concentration steps over all rows before the fit says that it has not settled
STEP_TOLERANCE = 1e-4
_DRAWS = 2**31


# -- isolation forest (Liu, Ting and Zhou 2008) -------------------------------------------------


def path_correction(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class Forest:
    """All trees as arrays of one shape: (tree, node)."""

    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray  # the right child follows the left one
    length: np.ndarray  # path length at a leaf
    depth: int
    rows: int

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trees filled up to ``depth``: feature and cut by place, children of i at 2i + 1 and 2i + 2, and the
        lengths of the last level. A leaf higher up sends all rows left, to its own length."""
        inner, trees = 2**self.depth - 1, np.arange(len(self.feature))
        feature, cut = (np.zeros((len(trees), inner), k) for k in (np.int64, np.float64))
        node = np.zeros((len(trees), 1), dtype=np.int64)
        for level in range(self.depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            f = self.feature[trees[:, None], node]
            leaf = f < 0
            feature[:, at] = np.maximum(f, 0)
            cut[:, at] = np.where(leaf, np.inf, self.cut[trees[:, None], node])
            left = np.where(leaf, node, self.left[trees[:, None], node])
            node = np.stack([left, np.where(leaf, node, left + 1)], axis=2).reshape(len(trees), -1)
        return feature, cut, self.length[trees[:, None], node]

    def scores(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        """2 ** (- mean path / expected path): higher is easier to isolate. ``rows`` at a time stay in the cache."""
        feature, cut, length = self.full()
        inner = feature.shape[1]
        out = np.zeros(len(x))
        for start in range(0, len(x), rows):
            some = np.ascontiguousarray(x[start : start + rows].T, dtype=np.float64)  # signal by signal
            n, flat, total = some.shape[1], some.ravel(), out[start : start + rows]
            row = np.arange(n)
            offset = feature * n  # where the signal of a node begins
            for at, cuts, lengths in zip(offset, cut, length):
                node = np.zeros(n, dtype=np.int64)
                for _ in range(self.depth):
                    right = flat.take(at.take(node, mode="clip") + row, mode="clip") > cuts.take(node, mode="clip")
                    node += node
                    node += 1
                    node += right
                total += lengths.take(node - inner)
        return np.exp2(-out / (len(self.feature) * max(path_correction(self.rows), 1e-12)))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """One random tree over a few hundred rows, as a node table."""
    nodes: list[list] = [[-1, 0.0, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes[at][3] = depth + path_correction(len(rows))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] > cut
        child = len(nodes)
        nodes[at][:3] = [f, cut, child]
        nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
        todo += [(child, rows[~right], depth + 1), (child + 1, rows[right], depth + 1)]
    out = pd.DataFrame(nodes, columns=["feature", "cut", "child", "length"])
    return out.assign(node=np.arange(len(out)))


def tree_samples(
    df: DataFrame, spec: TelemetrySpec, trees: int, rows: int, seed: int
) -> DataFrame:
    """About ``rows`` random rows for each tree, never more, drawn by a hash of the row key.

    A row is offered to a few random trees only, so the work is one pass plus a sample whose size
    does not depend on the table's.
    """
    n = df.count()
    if n == 0:
        raise ValueError("isolation forest: no rows to fit on")
    wanted = trees * rows * 1.25  # spare offers, so that few trees stay short
    slots = min(trees, max(1, math.ceil(wanted / n)))
    share = min(1.0, wanted / (n * slots))
    per_slot = trees / slots
    draw = lambda salt: F.pmod(
        F.xxhash64(*spec.key, F.col("_slot"), F.lit(f"{seed}:{salt}")), F.lit(_DRAWS)
    ) / F.lit(float(_DRAWS))
    offered = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_slot"))
    offered = offered.filter(draw("take") < share).select(
        "*",
        F.floor(F.col("_slot") * F.lit(per_slot) + draw("tree") * F.lit(per_slot))
        .cast("int")
        .alias("tree"),
        F.xxhash64(*spec.key, F.lit(f"{seed}:order")).alias("_order"),
    )
    return offered.filter(F.col("tree") < trees).drop("_slot")


class IsolationForest(Estimator):
    def __init__(
        self,
        spec: TelemetrySpec = DEFAULT,
        *,
        trees: int = TREES,
        rows: int = TREE_ROWS,
        seed: int = SEED,
    ):
        super().__init__()
        self.spec, self.trees, self.rows, self.seed = spec, trees, rows, seed

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        """Rows without NULL signals in, one small group of sampled rows per tree."""
        spec, rows, seed = self.spec, self.rows, self.seed
        signals = list(spec.signals)
        filled = dataset.select(*spec.key, *signals)
        limit = max(1, math.ceil(math.log2(max(2, rows))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            picked = pdf.sort_values(["_order", *spec.key]).head(rows)
            rng = np.random.default_rng([seed, tree])
            nodes = grow_tree(picked[signals].to_numpy("float64"), rng, limit)
            return nodes.assign(tree=tree)[["tree", "node", "feature", "cut", "child", "length"]]

        grown = (
            tree_samples(filled, spec, self.trees, rows, seed)
            .groupBy("tree")
            .applyInPandas(
                grow, "tree int, node int, feature int, cut double, child int, length double"
            )
        )
        # at most 2 * rows nodes for each tree
        nodes = grown.toPandas().sort_values(["tree", "node"])
        kinds = nodes["tree"].unique()
        width = int(nodes["node"].max()) + 1
        shape = (len(kinds), width)
        held = {
            "feature": np.full(shape, -1, dtype=np.int64),
            "cut": np.zeros(shape),
            "child": np.zeros(shape, dtype=np.int64),
            "length": np.zeros(shape),
        }
        at = (np.searchsorted(kinds, nodes["tree"]), nodes["node"].to_numpy())
        for name, array in held.items():
            array[at] = nodes[name].to_numpy()
        forest = Forest(
            held["feature"], held["cut"], held["child"], held["length"], limit, rows
        )
        return IsolationForestModel(spec, forest)


class IsolationForestModel(Model):
    def __init__(self, spec: TelemetrySpec, forest: Forest, out: str = "isolation"):
        super().__init__()
        self.spec, self.forest, self.out = spec, forest, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.forest)

        @F.pandas_udf("double")
        def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = held.value
            for columns in batches:
                x = np.column_stack([c.to_numpy("float64") for c in columns])
                yield pd.Series(forest.scores(x))

        return dataset.withColumn(self.out, isolation(*[F.col(s) for s in self.spec.signals]))


# -- robust distance (Rousseeuw and Van Driessen 1999; starts in starts.py) ----------------------


def chi2_quantile(p: float, dof: int) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


@dataclass(frozen=True)
class Ellipsoid:
    """Squared distance to ``centre`` under ``inverse``, as a column expression."""

    names: tuple[str, ...]
    centre: np.ndarray
    inverse: np.ndarray

    def distance(self) -> Column:
        # |U (x - c)|^2 with inverse = U'U: a sum of squares, never negative
        upper = np.linalg.cholesky(self.inverse).T
        terms = []
        for i, row in enumerate(upper):
            inner = total(
                [
                    (F.col(c) - F.lit(float(m))) * F.lit(float(w))
                    for c, m, w in list(zip(self.names, self.centre, row))[i:]
                ]
            )
            terms.append(inner * inner)
        return total(terms)


def mean_and_covariance(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """All means and cross products in one aggregation, for columns on a common scale."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(
        F.count(F.lit(1)),
        *[F.sum(c) for c in names],
        *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs],
    ).first()
    n, mean = row[0], np.array(row[1 : k + 1], dtype=float) / row[0]
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k + 1 :]):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    return n, mean, cov


class RobustDistance(Estimator):
    """Robust covariance: the most compact ``support`` of all rows, by concentration from fixed starts.

    All starts see all rows (``starts.most_compact``). The shape is then scaled to the normal and
    refitted once on the rows that are plausible under it. An empty table is an error.
    """

    def __init__(
        self,
        spec: TelemetrySpec = DEFAULT,
        *,
        support: float = SUPPORT,
        max_steps: int = MAX_STEPS,
    ):
        super().__init__()
        self.spec, self.support, self.max_steps = spec, support, max_steps

    def _fit(self, dataset: DataFrame) -> "RobustDistanceModel":
        spec = self.spec
        moments = signal_moments(dataset, spec)
        names = tuple(f"_z_{s}" for s in spec.signals)
        z = dataset.select(
            *[standardised(moments, s).alias(c) for s, c in zip(spec.signals, names)]
        ).persist()
        k = len(names)
        ridge = RIDGE * np.eye(k)
        try:
            found = most_compact(
                z, k, support=self.support, ridge=RIDGE, tolerance=STEP_TOLERANCE, max_steps=self.max_steps
            )
            shape = Ellipsoid(names, found[0], np.linalg.inv(found[1] + ridge))
            # scale to the normal, then refit once on the rows that are plausible under it
            factor = max(distance_quantile(z, found, 0.5, RIDGE) / chi2_quantile(0.5, k), 1e-12)
            kept = z.filter(shape.distance() <= factor * chi2_quantile(0.975, k))
            n, mean, cov = mean_and_covariance(kept, names)
            if n > k:
                shape = Ellipsoid(names, mean, np.linalg.inv(cov + ridge))
        finally:
            z.unpersist()
        return RobustDistanceModel(spec, moments, shape)


class RobustDistanceModel(Model):
    def __init__(self, spec: TelemetrySpec, moments, shape: Ellipsoid, out: str = "distance"):
        super().__init__()
        self.spec, self.moments, self.shape, self.out = spec, moments, shape, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = [
            standardised(self.moments, s).alias(c)
            for s, c in zip(self.spec.signals, self.shape.names)
        ]
        wide = dataset.select("*", *z)
        return wide.select(*dataset.columns, self.shape.distance().alias(self.out))


# -- the detectors ------------------------------------------------------------------------------


class MultivariateDetector(Estimator):
    """The larger of the scaled isolation score and the scaled robust distance."""

    name = "multivariate"

    def __init__(self, spec: TelemetrySpec = DEFAULT, *, trees: int = TREES, seed: int = SEED):
        super().__init__()
        self.spec, self.trees, self.seed = spec, trees, seed

    def _fit(self, dataset: DataFrame) -> "MultivariateModel":
        spec = self.spec
        fill = signal_medians(dataset, spec)
        filled = impute(dataset.select(*spec.key, *spec.signals), fill)
        forest = IsolationForest(spec, trees=self.trees, seed=self.seed).fit(filled)
        distance = RobustDistance(spec).fit(filled)
        scored = distance.transform(forest.transform(filled))
        scales = fit_minmax(scored, ["isolation", "distance"])
        return MultivariateModel(spec, fill, forest, distance, scales)


class MultivariateModel(Model):
    name = "multivariate"

    def __init__(self, spec, fill, forest, distance, scales: dict[str, MinMax]):
        super().__init__()
        self.spec, self.fill, self.forest, self.distance, self.scales = (
            spec,
            fill,
            forest,
            distance,
            scales,
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = {s: f"_raw_{s}" for s in self.spec.signals}
        held = dataset.select("*", *[F.col(s).alias(r) for s, r in raw.items()])
        scored = self.distance.transform(self.forest.transform(impute(held, self.fill)))
        best = F.greatest(*[m.of(F.col(c)) for c, m in self.scales.items()])
        back = [F.col(raw[c]).alias(c) if c in raw else F.col(c) for c in dataset.columns]
        return scored.select(*back, best.alias(self.name))


class ReconstructionDetector(Estimator):
    """What the first principal directions of the standardised signals cannot reproduce."""

    name = "reconstruction"

    def __init__(self, spec: TelemetrySpec = DEFAULT, *, directions: int = BOTTLENECK):
        super().__init__()
        self.spec, self.directions = spec, directions

    def _fit(self, dataset: DataFrame) -> "ReconstructionModel":
        spec = self.spec
        moments = signal_moments(dataset, spec)
        names = [f"_z_{s}" for s in spec.signals]
        z = dataset.select(
            *[standardised(moments, s).alias(c) for s, c in zip(spec.signals, names)]
        )
        _, mean, cov = mean_and_covariance(z, names)
        _, vectors = np.linalg.eigh(cov)
        model = ReconstructionModel(spec, moments, mean, vectors[:, -self.directions :].T, None)
        scored = dataset.select(model.error().alias(self.name))
        return ReconstructionModel(
            spec, moments, mean, model.vectors, fit_minmax(scored, [self.name])[self.name]
        )


class ReconstructionModel(Model):
    name = "reconstruction"

    def __init__(self, spec, moments, mean, vectors, scale: MinMax | None):
        super().__init__()
        self.spec, self.moments, self.mean, self.vectors, self.scale = (
            spec,
            moments,
            mean,
            vectors,
            scale,
        )

    def error(self) -> Column:
        """Mean squared residual; the directions are orthonormal, so no vector is rebuilt."""
        z = [
            standardised(self.moments, s) - F.lit(float(m))
            for s, m in zip(self.spec.signals, self.mean)
        ]
        whole = total([v * v for v in z])
        kept = []
        for row in self.vectors:
            dot = total([v * F.lit(float(w)) for v, w in zip(z, row)])
            kept.append(dot * dot)
        residual = whole - total(kept) if kept else whole
        return F.greatest(residual, F.lit(0.0)) / F.lit(float(len(z)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select("*", self.scale.of(self.error()).alias(self.name))

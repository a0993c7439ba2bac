"""Robust covariance from deterministic starts over all rows (Hubert, Rousseeuw and Verdonck 2012).

Six scatter estimates that outliers cannot pull far are made from every row, rescaled along their own axes
by a robust scale, and each is concentrated on the most compact share of all rows. All starts share every
pass. Nothing is drawn at random, and ranks and cuts are counted in fixed cells, so the layout of the
table does not change the result beyond rounding.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 200  # cells per unit of asinh: near the centre a cell is 1/200 of a deviation wide
CUT_CELLS = 2000  # cells per unit of log(1 + d): a cut is met within 0.05 % of 1 + d
NAMES = ("tanh", "ranks", "normal_scores", "signs", "spatial_signs", "compact_half")

Shape = tuple[np.ndarray, np.ndarray]
Values = Callable[[np.ndarray], np.ndarray]


def cell_counts(z: DataFrame, values: Values, cells: Callable[[np.ndarray], np.ndarray]) -> dict[int, pd.Series]:
    """Rows per (column, cell) of what ``values`` makes of the rows, for all columns in one pass.

    Cells are counted in the tasks first; their number is bounded by the range of a double.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.Series] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            at = cells(values(pdf.to_numpy("float64")))
            for j in range(at.shape[1]):
                cell, n = np.unique(at[:, j], return_counts=True)
                new = pd.Series(n, index=cell)
                held[j] = new if j not in held else held[j].add(new, fill_value=0)
        for j, part in held.items():
            yield pd.DataFrame({"j": j, "cell": part.index.astype("int64"), "n": part.to_numpy("int64")})

    counted = z.mapInPandas(count, "j int, cell long, n long").groupBy("j", "cell").agg(F.sum("n").alias("n"))
    got = counted.toPandas().sort_values(["j", "cell"])
    return {int(j): part.set_index("cell")["n"] for j, part in got.groupby("j")}


def spread_cells(x: np.ndarray) -> np.ndarray:
    return np.floor(np.arcsinh(x) * CELLS).astype(np.int64)


def _cell_middle(cell: np.ndarray) -> np.ndarray:
    return np.sinh((cell + 0.5) / CELLS)


def centre_and_scale(counts: pd.Series) -> tuple[float, float]:
    """Median and shortest half (as a normal deviation) of one column of cells.

    The scale is 0 if half of the rows lie in one cell.
    """
    n = counts.to_numpy()
    at = _cell_middle(counts.index.to_numpy())
    upto = np.cumsum(n)
    half = (upto[-1] + 1) // 2
    centre = at[np.searchsorted(upto, half)]
    last = np.searchsorted(upto, upto - n + half)  # the cell that completes a half begun at each cell
    open_ = last < len(n)
    widths = at[last[open_]] - at[open_]
    return float(centre), float(widths.min() / (2 * NormalDist().inv_cdf(0.75)))


def moment_sums(z: DataFrame, parts: Callable[[np.ndarray], list[np.ndarray]], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, mean, second moment) of each of several frames made of the rows, in one pass."""
    size = 1 + k + k * k

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: np.ndarray | None = None
        for pdf in batches:
            made = parts(pdf.to_numpy("float64"))
            new = np.array([np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]) for x in made])
            held = new if held is None else held + new
        if held is not None:
            yield pd.DataFrame({"part": np.arange(len(held)), "cells": list(held)})

    lines = z.mapInPandas(sums, "part int, cells array<double>")
    added = lines.groupBy("part").agg(*[F.sum(F.col("cells")[i]).alias(f"c{i}") for i in range(size)])
    out = []
    for row in added.toPandas().sort_values("part").drop(columns="part").to_numpy("float64"):
        n = max(row[0], 1.0)
        out.append((row[0], row[1 : k + 1] / n, row[k + 1 :].reshape(k, k) / n))
    return out


def _distances(z: np.ndarray, shapes: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Squared distances to (centre, upper factor of the inverse), a column for each shape."""
    return np.column_stack([np.square((z - c) @ u.T).sum(1) for c, u in shapes])


def _factored(shape: Shape, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    centre, cov = shape
    return centre, np.linalg.cholesky(np.linalg.inv(cov + ridge * np.eye(len(cov)))).T


def cut_cells(d: np.ndarray) -> np.ndarray:
    return np.floor(np.log1p(d) * CUT_CELLS).astype(np.int64)


def _cuts(counts: dict[int, pd.Series], share: float) -> np.ndarray:
    """Per column the first cell at which ``share`` of the rows are reached."""
    out = []
    for j in sorted(counts):
        upto = np.cumsum(counts[j].to_numpy())
        out.append(counts[j].index[np.searchsorted(upto, share * upto[-1])])
    return np.array(out, dtype=np.int64)


def distance_quantile(z: DataFrame, shape: Shape, share: float, ridge: float) -> float:
    """The squared distance that ``share`` of the rows do not exceed, within a cell."""
    factor = _factored(shape, ridge)
    cell = _cuts(cell_counts(z, lambda x: _distances(x, [factor]), cut_cells), share)[0]
    return float(np.expm1((cell + 0.5) / CUT_CELLS))


def first_scatters(z: DataFrame, k: int) -> list[Shape]:
    """Centre and covariance by each of the estimates in ``NAMES``."""
    columns = cell_counts(z, lambda x: x, spread_cells)
    if not columns:
        raise ValueError("robust covariance: no rows to fit on")
    fitted = [centre_and_scale(columns[j]) for j in range(k)]
    centre = np.array([c for c, _ in fitted])
    scale = np.array([s if s > 0 else 1.0 for _, s in fitted])
    rank_cells, ranks, normal = [], [], []
    for j in range(k):
        n = columns[j].to_numpy()
        middle = (np.cumsum(n) - n / 2) / n.sum()  # mid-rank of a cell
        rank_cells.append(columns[j].index.to_numpy())
        ranks.append(middle)
        normal.append(np.array([NormalDist().inv_cdf(p) for p in middle]))

    def whole(x: np.ndarray) -> np.ndarray:
        return (x - centre) / scale

    def size(x: np.ndarray) -> np.ndarray:
        return np.square(whole(x)).sum(1, keepdims=True)

    half = _cuts(cell_counts(z, size, cut_cells), 0.5)[0]

    def parts(x: np.ndarray) -> list[np.ndarray]:
        u = whole(x)
        at = spread_cells(x)
        place = [np.searchsorted(rank_cells[j], at[:, j]) for j in range(k)]
        long = np.linalg.norm(u, axis=1, keepdims=True)
        return [
            np.tanh(u),
            np.column_stack([ranks[j][place[j]] for j in range(k)]),
            np.column_stack([normal[j][place[j]] for j in range(k)]),
            np.sign(u),
            np.divide(u, long, out=np.zeros_like(u), where=long > 0),
            u[cut_cells(size(x))[:, 0] <= half],
        ]

    axes = []
    for name, (_, mean, second) in zip(NAMES, moment_sums(z, parts, k)):
        centred = name in ("signs", "spatial_signs")
        axes.append(np.linalg.eigh(second if centred else second - np.outer(mean, mean))[1])
    # the axes of an estimate are kept, its lengths are not: they come from the rows along each axis
    turned = np.column_stack(axes)
    along = cell_counts(z, lambda x: whole(x) @ turned, spread_cells)
    out = []
    for i, axis in enumerate(axes):
        lines = [centre_and_scale(along[i * k + j]) for j in range(k)]
        middle, length = np.array([c for c, _ in lines]), np.array([s for _, s in lines])
        cov = (axis * np.square(np.maximum(length, 1.0 / CELLS))) @ axis.T
        out.append((centre + scale * (axis @ middle), cov * np.outer(scale, scale)))
    return out


def log_det(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov)[1])


def most_compact(z: DataFrame, k: int, *, support: float, ridge: float, tolerance: float, max_steps: int) -> Shape:
    """Centre and covariance of the ``support`` of all rows whose covariance has the least determinant.

    ``z`` holds ``k`` columns without NULLs. Every start first takes its closest half, then ``support`` of
    the rows until its determinant settles; the best start wins, the first in ``NAMES`` on a tie.
    """
    shapes = first_scatters(z, k)
    before = [math.inf] * len(shapes)
    running = list(range(len(shapes)))
    for step in range(max_steps + 1):
        factors = [_factored(shapes[i], ridge) for i in running]
        share = min(0.5, support) if step == 0 else support
        cuts = _cuts(cell_counts(z, lambda x: _distances(x, factors), cut_cells), share)

        def near(x: np.ndarray) -> list[np.ndarray]:
            at = cut_cells(_distances(x, factors))
            return [x[at[:, i] <= cuts[i]] for i in range(len(cuts))]

        going = []
        for i, (_, mean, second) in zip(running, moment_sums(z, near, k)):
            shapes[i] = (mean, second - np.outer(mean, mean))
            now = log_det(shapes[i][1] + ridge * np.eye(k))
            # the first step counts half of the rows only, so it is not compared with the next one
            if step < 2 or before[i] - now > tolerance * max(1.0, abs(now)):
                going.append(i)
            before[i] = now
        running = going
        if not running:
            break
    else:
        warnings.warn(f"the robust covariance has not settled in {max_steps} steps", stacklevel=2)
    return shapes[min(range(len(shapes)), key=lambda i: before[i])]

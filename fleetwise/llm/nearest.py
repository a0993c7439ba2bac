"""Exact search for the largest inner products, by KD-trees.

Vectors are dealt into shards of about ``shard_rows`` by a hash of their id, so that copies and
clusters spread evenly. A task builds the tree of one shard: splits at the median of the widest
dimension, every node with the tight bounding box of its rows. A box bounds the inner product with a
query from above (per dimension the better of its two faces); nodes are visited best bound first, and
a search ends when no open box can reach the k-th best score.

Every query first searches the shard it hashes to. The k-th score found there goes with it to all
other shards as a floor, so that they skip what cannot enter the result. Queries come in blocks of
bounded size; a task holds one shard and one block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwise.shared import kept, scope, stored


@dataclass(frozen=True)
class Settings:
    k: int = 5
    shard_rows: int = 4096
    block_rows: int = 2048
    leaf_rows: int = 64


@dataclass(frozen=True)
class Tree:
    ids: np.ndarray
    rows: np.ndarray  # in the order of the leaves; the rows of a leaf by id
    low: np.ndarray
    high: np.ndarray
    kids: np.ndarray  # -1, -1 for leaves
    span: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int) -> Tree:
    order, low, high, kids, span = np.arange(len(ids)), [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        part = rows[order[a:b]]
        low.append(part.min(0))
        high.append(part.max(0))
        kids.append([-1, -1])
        span.append((a, b))
        me = len(low) - 1
        if parent >= 0:
            kids[parent][side] = me
        widths = high[me] - low[me]
        if b - a > leaf_rows and len(widths) and widths.max() > 0:
            axis = int(np.argmax(widths))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            todo += [(a, a + middle, me, 0), (a + middle, b, me, 1)]
        else:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
    return Tree(ids[order], rows[order], np.array(low), np.array(high), np.array(kids), np.array(span))


def _number(rows: np.ndarray, queries: np.ndarray):
    """A type in which all inner products are exact: floats where 53 bits do, else wider ones."""
    most = [int(np.abs(x.astype(object)).max()) if x.size else 0 for x in (rows, queries)]
    size = most[0] * most[1] * max(1, rows.shape[1])
    return np.float64 if size < 2**53 else np.int64 if size < 2**62 else object


def search(tree: Tree, query_ids, queries: np.ndarray, floors, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the ``k`` best rows per query that reach its floor, ties to smaller ids."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = plus @ tree.high.T + minus @ tree.low.T
    out = []
    for query_id, query, bound, floor in zip(query_ids, queries, bounds, floors, strict=True):
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        least = floor
        open_ = [(-bound[0], 0)]
        while open_:
            top, node = heapq.heappop(open_)
            if least is not None and -top < least:
                break
            left, right = tree.kids[node]
            if left >= 0:
                heapq.heappush(open_, (-bound[left], left))
                heapq.heappush(open_, (-bound[right], right))
                continue
            a, b = tree.span[node]
            scores = tree.rows[a:b] @ query
            if least is not None:
                if scores.max() < least:
                    continue
                at = np.flatnonzero(scores >= least)
            else:
                at = np.arange(b - a)
            for i in at:
                if tree.ids[a + i] == query_id:
                    continue
                found = (int(scores[i]), -int(tree.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                least = best[0][0]
        out += [(int(query_id), -name, score) for score, name in best]
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), width)


KIND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _visited(vectors: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame:
    """All hits of ``queries`` (vec_id, vector, floor, width, shard, block) in their shards."""

    def visit(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return KIND.empty_table()
        width = rows.column("width")[0].as_py()
        own, theirs = _matrix(rows.column("vector"), width), _matrix(asked.column("vector"), width)
        number = _number(own, theirs)
        tree = build(rows.column("vec_id").to_numpy(), own.astype(number), settings.leaf_rows)
        floors = asked.column("floor").to_pylist()
        found = search(tree, asked.column("vec_id").to_numpy(), theirs.astype(number), floors, settings.k)
        found = [(q, i, min(max(s, -(2**63)), 2**63 - 1)) for q, i, s in found]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=KIND)

    key = ["width", "shard", "block"]
    return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(visit, "query_id bigint, vec_id bigint, score bigint")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``vector``: every component x as floor(256 x), beyond 64 bits the nearest such.

    Rows whose id or vector is null, or whose vector holds null, NaN or an infinity, are left out;
    rows that repeat id and vector count once.
    """
    inf = float("inf")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return (
        embeddings.select(F.col("vec_id").cast("bigint"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(sound)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
        .distinct()
    )


def top_inner_products(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best ``vectors`` for each of ``queries``.

    Both have ``vec_id`` and ``vector`` (array of bigint); rows with the query's own id are no candidates,
    and vectors meet only vectors of their own length. Scores are exact integers, held to 64
    bits; ties go to the smaller id. A query without candidates has no rows.
    """
    with scope():
        shaped = stored(vectors.select("vec_id", "vector", F.size("vector").alias("width")), "vectors")
        n_shards = shaped.count() // settings.shard_rows + 1
        home = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
        shaped = shaped.withColumn("shard", home)
        asked = stored(queries.select("vec_id", "vector", F.size("vector").alias("width"), home.alias("home")), "queries")
        n_blocks = asked.count() // settings.block_rows + 1
        floor = F.lit(None).cast("bigint").alias("floor")
        zero = F.lit(0).alias("block")
        near = stored(
            _visited(shaped.select("*", zero), asked.select("vec_id", "vector", "width", floor, F.col("home").alias("shard"), zero), settings), "near"
        )
        kth = near.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        kth = kth.where(F.col("n") >= settings.k).select(F.col("query_id").alias("vec_id"), F.col("kth").alias("floor"))
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
        spread = asked.join(kth, "vec_id", "left").select("vec_id", "vector", "width", "floor", "home", block.alias("block"), others)
        copies = shaped.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        far = _visited(copies, spread.where("shard <> home").drop("home"), settings)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = near.unionByName(far).distinct().withColumn("rank", F.row_number().over(order))
        return kept(ranked.where(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score"), "nearest")

"""Scoring texts by prediction by partial matching, on bytes.

The trie of byte contexts of the training texts, down to ``order`` bytes, is a table of the distinct
runs of ``order + 1`` bytes with their counts; counts of shorter contexts are sums of it. It is gathered
by one shuffle of counts that every task has added up beforehand, and it grows with the corpus.

A byte is coded in the longest context seen; if it has not followed there, an escape is coded and
the next shorter context tried, without the bytes that the longer one has excluded. With count c of
the byte, n of the context and q distinct bytes after it, both after exclusion, the byte has
(2c - 1) / 2n and the escape q / 2n. A byte never seen at all gets an equal share of the last escape.
A text is framed by a byte that UTF-8 never has, so its end is coded too, and the probabilities of
all texts add up to one.

What a byte costs depends on its run alone, so costs are worked out once per distinct run: in groups
that share the last two context bytes, which hold all longer contexts of their runs; the contexts
of one and no byte are a table of 65,536 pairs. Then every text looks its runs up. As long as the
tables have at most ``table_rows`` entries, they are sent to all tasks. Beyond that, texts are
dealt into blocks, every block asks the tables for its own runs and words by a join, and is scored
with the answer; a block's dictionary is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import NOT_SPACE, slices, text_bytes, words
from fleetwise.shared import kept, scope, stored

FRAME = 0xFF
RUN, WORD = 0, 1
FLUSH = 1_500_000  # keys that a task collects before it adds them up, and hands them on if half are distinct
GROUPS = 2048
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Settings:
    """``order``: context bytes, at most 6; ``table_rows``: entries that may be sent to all tasks."""

    order: int = 5
    table_rows: int = 8_000_000


def byte_runs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte of every text, its run; and where each text begins in them."""
    data, at = text_bytes(texts)
    n = len(texts)
    framed = np.full(len(data) + n * (order + 1), FRAME, np.uint8)
    coded = np.ones(len(framed), bool)
    first = at[:-1] + np.arange(n) * (order + 1)
    for j in range(order):
        coded[first + j] = False
    place = np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, np.diff(at))
    framed[place] = data
    end = np.flatnonzero(coded)
    runs = np.zeros(len(end), np.uint64)
    for j in range(order, -1, -1):
        runs <<= np.uint64(8)
        runs |= framed[end - j]
    return runs, np.append(at[:-1] + np.arange(n), len(end))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)


def gathered(docs: DataFrame, settings: Settings) -> DataFrame:
    """``kind``, ``key``, ``n``: counts in training texts of byte runs (0 if only in others) and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {RUN: ([], []), WORD: ([], [])}

        def flush(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(*held[kind])
            held[kind] = ([keys], [n])
            if len(keys) >= least:
                held[kind] = ([], [])
                for i in range(0, len(keys), 200_000):
                    k = keys[i : i + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + 200_000])], ["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch):
                text, train = part.column("text"), part.column("train").to_numpy(zero_copy_only=False)
                runs, at = byte_runs(text, settings.order)
                for flag in (False, True):
                    keys, n = np.unique(runs[np.repeat(train == flag, np.diff(at))], return_counts=True)
                    held[RUN][0].append(keys)
                    held[RUN][1].append(n * flag)
                found = words(text, NOT_SPACE)
                keys, n = np.unique(found.prefix()[np.repeat(train, np.diff(found.first))], return_counts=True)
                held[WORD][0].append(keys)
                held[WORD][1].append(n)
                for kind in held:
                    if sum(map(len, held[kind][0])) > FLUSH:
                        yield from flush(kind, FLUSH // 2)
        for kind in held:
            yield from flush(kind, 1)

    return docs.select("text", "train").mapInArrow(count, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _symbol(c, n):
    return np.log10((2 * c - 1) / (2 * n))


def _escape(n, q):
    return np.where(q > 0, np.log10(q / (2 * n)), 0.0)


def run_costs(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probabilities of the last bytes of ``runs`` (sorted, all runs with their last two
    context bytes), given the counts of all pairs of bytes in the training texts."""
    with np.errstate(all="ignore"):
        single = pairs.reshape(256, 256).sum(0)
        n0, q0 = single.sum(), (single > 0).sum()
        after = np.full(256, -np.log10(256 - q0) if q0 < 256 else 0.0)
        cost = np.where(single > 0, _symbol(single, n0), (_escape(n0, q0) if n0 else 0.0) + after)
        below = (np.arange(256, dtype=np.uint64), single, np.full(256, n0), np.full(256, q0), cost, after)
        for depth in range(1, order + 1):
            if depth == 1:
                key, n = np.arange(65536, dtype=np.uint64), pairs
            else:
                key, where = np.unique(runs & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
                n = np.bincount(where, counts, len(key))
            context = key >> np.uint64(8)
            group = np.cumsum(np.append(0, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
            total, kinds = np.bincount(group, n)[group], np.bincount(group, n > 0)[group]
            low_key, low_n, low_total, low_kinds, low_cost, low_after = below
            j = np.searchsorted(low_key, key & np.uint64((1 << 8 * depth) - 1))
            out = np.bincount(group, np.where(n > 0, low_n[j], 0))[group]
            rest_n, rest_q = low_total[j] - out, low_kinds[j] - kinds
            after = np.where(low_n[j] > 0, _symbol(low_n[j], rest_n), _escape(rest_n, rest_q) + low_after[j])
            cost = np.where(total > 0, np.where(n > 0, _symbol(n, total), _escape(total, kinds) + after), low_cost[j])
            below = (key, n, total, kinds, cost, after)
    return cost[np.searchsorted(below[0], runs)] if order > 1 else cost[runs.astype(np.int64)]


def costs(seen: DataFrame, settings: Settings) -> DataFrame:
    """``key``, ``value``: the log10 probability that every run of ``seen`` gives its last byte."""
    runs = seen.where(F.col("kind") == RUN)
    short = runs.groupBy(F.expr("CAST(key & 65535 AS INT)").alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(65536, np.int64)
    pairs[short.column("pair").to_numpy()] = short.column("n").to_numpy()
    order = settings.order

    def price(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        value = run_costs(rows.key.to_numpy().view(np.uint64), rows.n.to_numpy(), pairs, order)
        return pd.DataFrame({"key": rows.key, "value": value})

    group = F.expr(f"CAST(shiftright(key, 8) & 65535 AS INT) % {GROUPS}").alias("part")
    return runs.select(group, "key", "n").groupBy("part").applyInPandas(price, "key bigint, value double")


@dataclass(frozen=True)
class Tables:
    """Sorted keys and their values; ``tokens`` and ``kinds`` are N and V of the base model."""

    runs: np.ndarray
    values: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    ends: int
    tokens: int
    kinds: int


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    distinct, where = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
    return np.where(table[at] == distinct, values[at], missing)[where]


def _scores(part: pa.RecordBatch, tables: Tables, order: int) -> pa.RecordBatch:
    text, n = part.column("text"), part.num_rows
    runs, at = byte_runs(text, order)
    value = _found(runs, tables.runs, tables.values, 0.0)
    score = np.bincount(np.repeat(np.arange(n), np.diff(at)), value, n)
    found = words(text, NOT_SPACE)
    doc = np.repeat(np.arange(n), np.diff(found.first))
    c = _found(found.prefix(), tables.words, tables.counts, 0)
    scale = np.log10(max(1, tables.tokens + tables.kinds + 1))
    base = np.bincount(doc, np.log10(c + 1.0) - scale, n) + np.log10(tables.ends + 1.0) - scale
    known = np.bincount(doc, c > 0, n).astype(np.int64) + (tables.ends > 0)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("train"), pa.array(np.diff(found.first) + 1), pa.array(known), pa.array(np.full(n, tables.tokens)), pa.array(base), pa.array(score)],
        ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


KIND = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _by_broadcast(docs: DataFrame, seen: DataFrame, priced: DataFrame, whole: Tables, order: int) -> DataFrame:
    """Scored and written; the tables leave the executors when that is done."""
    spark = docs.sparkSession

    def sorted_table(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        rows = df.toArrow()
        keys = rows.column(0).to_numpy().view(np.uint64)
        turn = np.argsort(keys)
        return keys[turn], rows.column(1).to_numpy()[turn]

    runs, values = sorted_table(priced.select("key", "value"), "value")
    keys, counts = sorted_table(seen.where(F.col("kind") == WORD).select("key", "n"), "n")
    if len(counts) and counts.max() < 2**32:
        counts = counts.astype(np.uint32)
    shared = spark.sparkContext.broadcast(Tables(runs, values, keys, counts, whole.ends, whole.tokens, whole.kinds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _scores(part, shared.value, order)

    scored = kept(docs.mapInArrow(score, KIND), "scored")
    shared.destroy()
    return scored


def _by_blocks(docs: DataFrame, seen: DataFrame, priced: DataFrame, whole: Tables, order: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size // BLOCK_BYTES + 1
    dealt = stored(docs.withColumn("block", F.floor(F.rand(7) * n_blocks)), "blocks")

    def asks(rows: pa.Table) -> pa.Table:
        runs, named = [], []
        for batch in rows.to_batches():
            for part in slices(batch):
                runs.append(np.unique(byte_runs(part.column("text"), order)[0]))
                named.append(np.unique(words(part.column("text"), NOT_SPACE).prefix()))
        runs, named = np.unique(np.concatenate(runs)), np.unique(np.concatenate(named))
        kinds = np.repeat(np.array([RUN, WORD], np.int8), [len(runs), len(named)])
        block = np.full(len(kinds), rows.column("block")[0].as_py())
        return pa.table({"block": block, "kind": kinds, "key": np.concatenate([runs, named]).view(np.int64)})

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        kind, key, value = (told.column(c).to_numpy() for c in ("kind", "key", "value"))
        turn = np.argsort(key.view(np.uint64))
        kind, key, value = kind[turn], key.view(np.uint64)[turn], value[turn]
        own = Tables(key[kind == RUN], value[kind == RUN], key[kind == WORD], value[kind == WORD], whole.ends, whole.tokens, whole.kinds)
        parts = [_scores(part, own, order) for batch in rows.to_batches() for part in slices(batch)]
        return pa.Table.from_batches(parts, schema=None if parts else pa.schema([]))

    asked = dealt.groupBy("block").applyInArrow(asks, "block bigint, kind tinyint, key bigint")
    table = priced.select(F.lit(RUN).cast("tinyint").alias("kind"), "key", "value").unionByName(
        seen.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value"))
    )
    told = stored(asked.join(table, ["kind", "key"]), "told")
    return kept(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, KIND), "scored")


def score_texts(docs: DataFrame, train: Column, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Every row is scored; the rows for which ``train`` holds (null: it holds) are learned from, repeated
    ones as often as they come. ``score`` is the log10 probability of the whole text, its end
    included; ``base_score`` that of its lower-cased words and an end mark under add-one counts.
    Null and empty texts consist of an end. Without training rows every byte has an equal share.
    Other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    with scope():
        seen = stored(gathered(docs, settings), "seen")
        priced = stored(costs(seen, settings), "priced")
        sizes = {r["kind"]: r for r in seen.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
        ends = docs.where("train").count()
        n_words = sizes[WORD]["rows"] if WORD in sizes else 0
        tokens = (sizes[WORD]["n"] if WORD in sizes else 0) + ends
        none = np.zeros(0)
        whole = Tables(none, none, none, none, ends, tokens, n_words + (ends > 0))
        way = _by_broadcast if sum(r["rows"] for r in sizes.values()) <= settings.table_rows else _by_blocks
        return way(docs, seen, priced, whole, settings.order)

"""URL filters: rules first, and a character language model for what no rule fits.

Two smoothed variable-order Markov models are counted on the URLs that rules allow and block. The
probability of a byte after ``k`` bytes is ``(c + weight * p_shorter) / (n + weight)``, from no
context up to ``order`` bytes, so long contexts count as far as they have been seen. A URL is judged
by the difference of its log-likelihoods per byte, against a cut that is calibrated on labelled URLs
the models have not seen.

Counts are exact. A run is a byte with the ``order`` bytes before it, as one whole number without
hashing; the table of the distinct runs with their counts per side is gathered by one shuffle of counts
that every task has added up beforehand, and counts of shorter contexts are sums of it. What a run adds to the
difference depends on the run alone, so it is worked out once per distinct run, in groups that share
the last two context bytes. Then every URL looks its runs up: in a table sent to all tasks up to
``table_rows`` entries, and beyond that in the answer to what its block of URLs has asked by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import mix, slices, text_bytes
from fleetwise.shared import kept, scope, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRID = 2000  # cells of the calibration histogram, over differences from -10 to 10
BITS = 9  # of a symbol: 0 before the text, 1 its end, the others bytes
FLUSH = 1_500_000  # runs that a task collects before it adds them up, and hands them on if half are distinct
GROUPS = 2048
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Settings:
    """``order``: context bytes, at most 6; ``table_rows``: runs that may be sent to all tasks; ``cells``
    belongs to the hashed counters (``_differences``) that ``judge`` does not use."""

    order: int = 5
    cells: int = 1 << 15
    weight: float = 4.0
    held: int = 5  # one in so many labelled URLs calibrates, by hash; the others are counted
    table_rows: int = 8_000_000


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits host and path, as a struct, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _framed(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, with ``pad`` empty ones before and an end behind each; where they
    are coded; and how many are coded in each text."""
    data, at = text_bytes(texts)
    n = len(texts)
    framed = np.zeros(len(data) + n * (pad + 1), np.uint64)
    framed[np.arange(len(data)) + np.repeat(np.arange(n) * (pad + 1) + pad, np.diff(at))] = data.astype(np.uint64) + np.uint64(2)
    framed[at[1:] + np.arange(n) * (pad + 1) + pad] = 1
    return framed, np.flatnonzero(framed), np.diff(at) + 1


def url_runs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte of every text, its run; and how many each text has."""
    framed, here, sizes = _framed(texts, order)
    runs = np.zeros(len(here), np.uint64)
    for k in range(order, -1, -1):
        runs = runs << np.uint64(BITS) | framed[here - k]
    return runs.view(np.int64), sizes


def gathered(urls: DataFrame, settings: Settings) -> DataFrame:
    """``run``, ``allowed``, ``blocked``: counts of runs in the URLs to learn from (``side`` 0 or 1; null: not
    learned from, its runs come with 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            runs, where = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
            n = [np.bincount(where, np.concatenate([c[s] for _, c in held]), len(runs)).astype(np.int64) for s in range(2)]
            held[:] = [(runs, np.array(n))]
            if len(runs) >= least:
                held.clear()
                for i in range(0, len(runs), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (runs, *n)], ["run", "allowed", "blocked"])

        for batch in batches:
            for part in slices(batch, "url"):
                side = part.column("side").fill_null(2).to_numpy(zero_copy_only=False)
                runs, sizes = url_runs(part.column("url"), settings.order)
                own, where = np.unique(runs, return_inverse=True)
                whose = np.repeat(side, sizes)
                held.append((own, np.array([np.bincount(where, whose == s, len(own)) for s in range(2)])))
                if sum(len(r) for r, _ in held) > FLUSH:
                    yield from flush(FLUSH // 2)
        if held:
            yield from flush(1)

    counted = urls.select("url", "side").mapInArrow(count, "run bigint, allowed bigint, blocked bigint")
    return counted.groupBy("run").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def run_logs(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, settings: Settings) -> np.ndarray:
    """The log-probability of the last bytes of ``runs`` (all runs with their last two context bytes),
    given the counts of all pairs of symbols (context, byte)."""
    pairs = pairs.reshape(1 << BITS, 1 << BITS)
    byte, before = runs & ((1 << BITS) - 1), runs >> BITS & ((1 << BITS) - 1)
    p = np.full(len(runs), 1 / 257)
    for k in range(settings.order + 1):
        if k == 0:
            c, n = pairs.sum(0)[byte], pairs.sum()
        elif k == 1:
            c, n = pairs[before, byte], pairs.sum(1)[before]
        else:
            key = runs & ((1 << BITS * (k + 1)) - 1)
            c, n = (np.bincount(i, counts)[i] for i in (np.unique(x, return_inverse=True)[1] for x in (key, key >> BITS)))
        p = (c + settings.weight * p) / (n + settings.weight)
    return np.log(p)


def priced(seen: DataFrame, settings: Settings) -> DataFrame:
    """``run``, ``value``: the log-probability of every run's last byte when allowed less that when blocked."""
    short = seen.groupBy(F.expr(f"CAST(run & {(1 << 2 * BITS) - 1} AS INT)").alias("pair")).agg(F.sum("allowed"), F.sum("blocked")).toArrow()
    pairs = np.zeros((2, 1 << 2 * BITS), np.int64)
    pairs[:, short.column("pair").to_numpy()] = [short.column(1).to_numpy(), short.column(2).to_numpy()]

    def price(rows: pd.DataFrame) -> pd.DataFrame:
        runs = rows.run.to_numpy()
        log = [run_logs(runs, rows[c].to_numpy(), pairs[s], settings) for s, c in enumerate(("allowed", "blocked"))]
        return pd.DataFrame({"run": runs, "value": log[0] - log[1]})

    group = F.expr(f"CAST(shiftright(run, {BITS}) & {(1 << 2 * BITS) - 1} AS INT) % {GROUPS}").alias("part")
    return seen.select(group, "run", "allowed", "blocked").groupBy("part").applyInPandas(price, "run bigint, value double")


def _means(part: pa.RecordBatch, runs: np.ndarray, values: np.ndarray, order: int) -> pa.RecordBatch:
    """``part`` with ``difference``, from the values of the sorted ``runs``, which hold all of its own."""
    own, sizes = url_runs(part.column("url"), order)
    found = values[np.searchsorted(runs, own)]
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, len(sizes))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(sums / sizes)], [*part.schema.names, "difference"])


def _scored(rows: DataFrame, values: DataFrame, n_values: int, settings: Settings) -> DataFrame:
    """``rows`` with ``difference``, from their ``url``, written; ``values`` are left behind."""
    order = settings.order
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", difference double"

    def in_order(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        runs = told.column("run").to_numpy()
        turn = np.argsort(runs)
        return runs[turn], told.column("value").to_numpy()[turn]

    if n_values <= settings.table_rows:
        shared = rows.sparkSession.sparkContext.broadcast(in_order(values.toArrow()))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "url"):
                    yield _means(part, *shared.value, order)

        out = kept(rows.mapInArrow(look_up, kind), "scored")
        shared.destroy()
        return out

    size = rows.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    dealt = stored(rows.withColumn("block", F.floor(F.rand(7) * (size // BLOCK_BYTES + 1))), "blocks")

    def asks(mine: pa.Table) -> pa.Table:
        runs = [np.unique(url_runs(p.column("url"), order)[0]) for b in mine.to_batches() for p in slices(b, "url")]
        runs = np.unique(np.concatenate(runs))
        return pa.table({"block": np.full(len(runs), mine.column("block")[0].as_py()), "run": runs})

    def answer(mine: pa.Table, told: pa.Table) -> pa.Table:
        table = in_order(told)
        parts = [_means(p, *table, order) for b in mine.drop_columns(["block"]).to_batches() for p in slices(b, "url")]
        return pa.Table.from_batches(parts)

    told = stored(dealt.select("block", "url").groupBy("block").applyInArrow(asks, "block bigint, run bigint").join(values, "run"), "told")
    return kept(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, kind), "scored")


def _cut(held: DataFrame) -> float:
    """Where the mean error of both sides is smallest on held labelled URLs; in the middle of ties."""
    cell = F.least(F.greatest(F.floor((F.col("difference") + 10) * (GRID / 20)), F.lit(0)), F.lit(GRID - 1))
    found = held.groupBy("side", cell.alias("cell")).count().collect()
    grid = np.zeros((2, GRID))
    for r in found:
        grid[r["side"], r["cell"]] = r["count"]
    if grid.sum(1).min() == 0:
        return 0.0
    share = np.cumsum(grid / grid.sum(1, keepdims=True), 1)
    wrong = np.append(1.0, share[0] + 1 - share[1])  # cutting below cell i blocks all cells before it
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] * 20 / GRID - 10)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], settings: Settings = Settings()) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``difference`` for every row of ``pages``.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains where the URL's path
    starts with the rule's, and the longest decides. The others get the verdict of the models,
    ``difference`` being the log-likelihood difference per byte. Null URLs, and those without ``://``,
    have empty host and path, so no rule fits them. Where rules label only one side, or nothing,
    the models cannot tell and allow. Equal URLs get equal verdicts. Other columns are not looked at.
    """
    asked = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = asked.withColumn("fit", by_rule(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "fit.*")
    known = F.when(F.col("verdict") == "allow", 0).when(F.col("verdict").isNotNull(), 1)
    held = F.pmod(F.xxhash64("url"), F.lit(settings.held)) == 0
    with scope():
        seen = stored(gathered(asked.select("url", F.when(~held, known).alias("side")), settings), "seen")
        size = seen.agg(F.count("*").alias("runs"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
        both = bool(size["allowed"] and size["blocked"])
        scored = _scored(asked, stored(priced(seen, settings), "priced"), size["runs"], settings) if both else asked.withColumn("difference", F.lit(0.0))
        cut = _cut(scored.where(held & known.isNotNull()).select(known.alias("side"), "difference")) if both else 0.0
    guess = F.when(F.col("difference") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"), "difference")


# Counters of a fixed number of hash cells: the same formula on few texts, with which tests compare.


def _cells(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the contexts of 0 to ``order`` bytes before each byte, and of the byte in each of
    them ([context or byte][length][byte]); and each byte's text. An end is coded behind every text."""
    data, at = text_bytes(texts)
    n, pad = len(texts), settings.order
    framed = np.zeros(len(data) + n * (pad + 1), np.uint64)
    framed[np.arange(len(data)) + np.repeat(np.arange(n) * (pad + 1) + pad, np.diff(at))] = data.astype(np.uint64) + np.uint64(2)
    framed[at[1:] + np.arange(n) * (pad + 1) + pad] = 1
    here = np.flatnonzero(framed)
    out = np.zeros((2, pad + 1, len(here)), np.int64)
    context = np.zeros(len(here), np.uint64)
    for k in range(pad + 1):
        if k:
            context = mix(context * np.uint64(0x9E3779B97F4A7C15) + framed[here - k] + np.uint64(1))
        byte = mix(context + framed[here] * np.uint64(0xD6E8FEB86659FD93))
        out[0, k] = context & np.uint64(settings.cells - 1)
        out[1, k] = byte & np.uint64(settings.cells - 1)
    return out, np.repeat(np.arange(n), np.diff(at) + 1)


def _differences(texts: pa.Array, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """Per text the log-likelihood under the allowed model less that under the blocked one, per byte."""
    cells, text = _cells(texts, settings)
    log = []
    for side in range(2):
        p = np.full(len(text), 1 / 257)
        for k in range(settings.order + 1):
            seen, c = counts[side, 0, k][cells[0, k]], counts[side, 1, k][cells[1, k]]
            p = (c + settings.weight * p) / (np.maximum(seen, c) + settings.weight)
        log.append(np.log(p))
    return np.bincount(text, log[0] - log[1], len(texts)) / np.bincount(text, minlength=len(texts))

"""Sharding over a fixed number of virtual slots.

Records are hashed into thousands of slots, once and for all; only the map from slots to shards ever
changes. It is made from the bytes of each slot, so shards come out nearly equal, and kept as a
table of versions. ``rebalance`` edits its newest version for what the slots weigh by now and saves the
next one: slots move to added shards until these have their share, from removed shards to the emptiest,
and from shards that have grown too full; no other slot moves. The map has as many rows as there are
slots, whatever the data.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwise.operators.ordered import rank_within
from fleetwise.shared import kept, new_path, scope, stored

SLOTS = 4096
OVERHEAD = 8  # bytes per record beside its text
SLACK = 0.02  # a shard that exceeds its share by more gives slots away


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot`` of every row.

    ``size`` counts the UTF-8 bytes of the text (none if null) and ``OVERHEAD``; the checksum of a null
    text is that of an empty one. Rows that share a doc_id share a slot; rows without one are
    spread by their text.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(1))).otherwise(F.xxhash64("doc_id"))
    return docs.select(
        F.col("doc_id").cast("bigint"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot; at most ``slots`` numbers of each reach the driver."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    size, n = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in found:
        size[r["virtual_slot"]], n[r["virtual_slot"]] = r["size"], r["n"]
    return size, n


def new_map(size: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every slot: slots by falling size, each to the shard with the fewest bytes."""
    out = np.zeros(len(size), np.int32)
    open_ = [(0, s) for s in range(shards)]
    for slot in np.argsort(-size, kind="stable"):
        load, shard = heapq.heappop(open_)
        out[slot] = shard
        heapq.heappush(open_, (load + int(size[slot]), shard))
    return out


def grown_map(old: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """``old`` with slots moved to the new shards alone, always from the fullest shard.

    A slot moves when it brings the new shard no further than its share of all bytes, or nearer.
    """
    out, before = old.copy(), int(old.max()) + 1 if len(old) else 0
    share = size.sum() / shards
    load = np.bincount(out, size, shards).astype(np.int64)
    for shard in range(before, shards):
        while load[shard] < share:
            giver = int(np.argmax(load[:before]))
            own = np.flatnonzero(out == giver)
            fits = own[(size[own] > 0) & (abs(load[shard] + size[own] - share) <= share - load[shard])]
            if not len(fits):
                break
            slot = fits[np.argmin(abs(size[fits] - min(share - load[shard], load[giver] - share)))]
            out[slot] = shard
            load[giver] -= size[slot]
            load[shard] += size[slot]
    return out


def shrunk_map(old: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """``old`` with the slots of shards that are no more, by falling size, each on the emptiest shard."""
    out = old.copy()
    stay = out < shards
    load = np.bincount(out[stay], size[stay], shards).astype(np.int64)
    gone = np.flatnonzero(~stay)
    for slot in gone[np.argsort(-size[gone], kind="stable")]:
        out[slot] = shard = int(np.argmin(load))
        load[shard] += size[slot]
    return out


def evened_map(old: np.ndarray, size: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """``old`` with slots moved from the fullest shard to the emptiest until none exceeds its share by ``slack``.

    The slot that brings the two closest moves; a single slot above the share stays where it is.
    """
    out, share = old.copy(), size.sum() / shards
    load = np.bincount(out, size, shards).astype(np.int64)
    stuck = np.zeros(shards, bool)  # shards from which no move helps any more
    while not stuck.all():
        giver, taker = int(np.argmax(np.where(stuck, -1, load))), int(np.argmin(load))
        if load[giver] <= share * (1 + slack):
            break
        own = np.flatnonzero(out == giver)
        own = own[(size[own] > 0) & (size[own] < load[giver] - load[taker])]
        if not len(own):
            stuck[giver] = True
            continue
        slot = own[np.argmin(abs(2 * size[own] - (load[giver] - load[taker])))]
        out[slot] = taker
        load[giver] -= size[slot]
        load[taker] += size[slot]
    return out


def edited_map(old: np.ndarray, size: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The next version of a map: for more shards, for fewer, or for the same number with other loads."""
    before = int(old.max()) + 1 if len(old) else 0
    if shards > before:
        return grown_map(old, size, shards)
    if shards < before:
        return shrunk_map(old, size, shards)
    return evened_map(old, size, shards, slack)


def save_map(spark: SparkSession, path: str, version: int, shard: np.ndarray) -> None:
    """Add a version to the map table at ``path``; earlier versions stay readable."""
    rows = [(version, i, int(s)) for i, s in enumerate(shard)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``virtual_slot``, ``shard`` of a version, by default the newest."""
    found = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).select("virtual_slot", "shard")


def placed(rows: DataFrame, shard_of: DataFrame, n: np.ndarray) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the record's place in its shard, without gaps from 0.

    Places run through the virtual slots of a shard in order; within one they follow doc_id,
    checksum and size. Rows are numbered by ranges of that order, which may cut a slot, and also a run
    of rows that are alike, anywhere; so neither a shard nor a slot is work for one task.
    """
    counts = rows.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(n)], "virtual_slot int, n bigint")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = shard_of.join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    alike = rows.withColumn("_nth", F.monotonically_increasing_id())
    numbered = rank_within(alike, ["virtual_slot"], ["doc_id", "text_crc32", "size", "_nth"], "nth").drop("_nth")
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("nth")).drop("start", "nth")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot``; version 1 of the map is written to ``path``.

    An empty table gives no rows. Other columns than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    with scope():
        path = path or new_path(spark, "slot_map")
        rows = stored(slotted(docs, slots), "slotted")
        size, n = slot_loads(rows, slots)
        save_map(spark, path, 1, new_map(size, shards))
        return kept(placed(rows, load_map(spark, path), n), "sharded")


def next_map(spark: SparkSession, path: str, size: np.ndarray, shards: int, slack: float = SLACK) -> DataFrame:
    """Load the newest version at ``path``, edit it for the bytes of its slots, and save it as the next one."""
    last = spark.read.schema("version int, virtual_slot int, shard int").parquet(path).agg(F.max("version")).first()[0]
    rows = load_map(spark, path, last).collect()  # as many as there are slots
    old = np.zeros(len(rows), np.int32)
    for r in rows:
        old[r["virtual_slot"]] = r["shard"]
    if len(size) != len(old):
        raise ValueError(f"the map at {path} has {len(old)} slots, not {len(size)}")
    save_map(spark, path, last + 1, edited_map(old, size, shards, slack))
    return load_map(spark, path, last + 1)


def rebalance(docs: DataFrame, shards: int, path: str, slots: int = SLOTS, slack: float = SLACK) -> DataFrame:
    """Every row of ``docs`` placed by the next version of the map at ``path``, with ``shard_before``.

    ``docs`` may hold other rows than those the map was made for. The newest version is edited, not made
    anew: rows whose slot keeps its shard stay. Earlier versions stay readable. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scope():
        rows = stored(slotted(docs, slots), "slotted")
        size, n = slot_loads(rows, slots)
        last = load_map(spark, path).withColumnRenamed("shard", "shard_before")
        last = stored(last, "map_before")  # before the next version is there
        after = next_map(spark, path, size, shards, slack)
        return kept(placed(rows, after, n).join(F.broadcast(last), "virtual_slot"), "rebalanced")

"""Similarity join of documents on their word n-grams.

Documents link when the Jaccard similarity of their n-gram sets reaches a threshold. The join is
exact; every filter below only leaves out pairs that cannot link.

* **Rare first.** All documents are counted into a table of counters with fixed size, one per hash
  cell of an n-gram. The order of n-grams is (counter, hash): n-grams that many documents share come
  last. Any fixed order gives the same links, so a crowded counter costs time, never a link.
* **Prefix.** Two sets that link share an n-gram among the first ``n - ceil(t n) + 1`` of each.
* **Copies.** Documents with equal sets are one class from the start, and one node of the graph.
* **Leaders.** In a group of documents that share a prefix n-gram, all are first compared with
  three of them (the one where the n-gram comes earliest, which is the least edited one, and those
  with the smallest and largest id). Pairs that these links already connect are not compared again:
  components need no second path. So a group of n near copies costs n comparisons, not n squared.
* **The rest** is a join of the group with itself, restricted to pairs of different components, with
  the length and the position filter in the join condition.
* **Suffix filter.** Per set a histogram of its hashes over fixed cells: sizes of the parts bound the
  number of elements on one side only.
* **Verification** counts the common elements of the whole sets, once per pair. The compressed texts are brought
  together for it, one shuffle for either side, and cut again: sets of 64-bit hashes are larger and do not shrink.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.components import components
from fleetwise.llm.kernel import SLICE_BYTES, joined, mix, packed, shingle_sets, slices
from fleetwise.shared import kept, scope, stored

BINS = 64
ID_BITS = 22
KEY_BITS = 24  # of the table of set keys that occur twice, 2 MB
SEEN = 1 << 16  # rows that a task remembers to leave out repeats before the shuffle
GRAM_BITS = 27  # of the table of n-grams that several classes have, 16 MB


@dataclass(frozen=True)
class Similarity:
    """``words`` per n-gram, threshold ``num / den``, and the number of frequency counters."""

    words: int = 5
    num: int = 4
    den: int = 5
    counters: int = 1 << 17

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def frequencies(docs: DataFrame, rule: Similarity) -> np.ndarray:
    """In how many documents the n-grams of each hash cell occur; as long as ``rule.counters``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(rule.counters, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = [s & np.uint64(rule.counters - 1) for s in shingle_sets(part.column("text"), rule.words)]
                seen += np.bincount(np.concatenate(sets).astype(np.int64), minlength=rule.counters)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen[cells])], ["cell", "n"])

    found = (
        docs.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(rule.counters, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def signatures(docs: DataFrame, rule: Similarity, seen: np.ndarray) -> DataFrame:
    """Per document the size of its set, the set's 128-bit key, its prefix and its histogram."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(seen, 2**31 - 1).astype(np.int32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for s in shingle_sets(part.column("text"), rule.words):
                    key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    first = np.lexsort((s, order[s & np.uint64(rule.counters - 1)]))[: rule.prefix(len(s))] if len(s) else []
                    bins = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS)
                    rows.append((len(s), *key.tolist(), s[first].view(np.int64) if len(s) else [], np.minimum(bins, 255).astype(np.uint8).tobytes()))
                n, k1, k2, prefix, bins = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
                    ["doc_id", "n", "k1", "k2", "prefix", "bins"],
                )

    kind = "doc_id bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>, bins binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, kind)


def _possible(pairs: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs that pass the length filter and the suffix filter."""
    side = classes.select("rep", "n", "bins").distinct()
    both = pairs.join(side.toDF("a", "na", "ha"), "a").join(side.toDF("b", "nb", "hb"), "b").select("a", "b", "na", "nb", "ha", "hb")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ha, hb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("ha", "hb"))
            apart = np.abs(ha - hb).sum(1)
            least = -(-rule.num * (na + nb) // (rule.num + rule.den))
            good = (rule.den * np.minimum(na, nb) >= rule.num * np.maximum(na, nb)) & (apart <= na + nb - 2 * least)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[good]) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(passing, "a bigint, b bigint").distinct()


def bit_table(cells: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits in which the cells (column ``cell``) are set; 32 in a number.

    It has a fixed size, so it may be sent to every task. Filled up it lets more through, which later steps drop.
    """
    words = (
        cells.groupBy(F.shiftright("cell", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 31 AS INT))")).alias("bits"))
    ).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return table


def is_set(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (table[cells >> 5] >> (cells & 31).astype(np.uint32)) & 1 > 0


def _cell(column: str, bits: int):
    """The cell of an n-gram or a key: its lowest bits."""
    return F.col(column).bitwiseAND(F.lit((1 << bits) - 1))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``text`` (compressed) of the documents in ``ids``, and of few others: a bit table says which are asked for.

    Texts of words are a fraction of the size of their sets of hashes. They are dealt by id, repeats gone before that.
    """
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ids.select(cell.alias("cell")), ID_BITS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        hash_of = lambda text: xxhash.xxh3_128_digest(text.as_buffer())
        for batch in batches:
            at = batch.column("cell").to_numpy()
            batch = batch.filter(pa.array(is_set(shared.value, at)))
            for part in slices(batch):
                small = packed(part.column("text"))
                new = []
                for row in zip(part.column("id").to_pylist(), map(hash_of, small), strict=True):
                    new.append(row not in seen)
                    seen.add(row)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([part.column("id"), small], ["id", "text"]).filter(pa.array(new))

    asked = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id IS NOT NULL")
    found = asked.withColumn("cell", cell).mapInArrow(gather, "id bigint, text binary")
    return found.repartition("id").distinct()


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The texts of the pairs of a batch, some megabytes at a time."""
    first, second, size = [], [], 0
    for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
        first.append(zlib.decompress(x.as_buffer()))
        second.append(zlib.decompress(y.as_buffer()))
        size += len(first[-1]) + len(second[-1])
        if size >= SLICE_BYTES:
            yield joined(first), joined(second)
            first, second, size = [], [], 0
    if first:
        yield joined(first), joined(second)


def _verified(pairs: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for first, second in _unpacked(batch):
                for u, v in zip(shingle_sets(first, rule.words), shingle_sets(second, rule.words), strict=True):
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    good.append(common > 0 and rule.den * common >= rule.num * (len(u) + len(v) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(linked, "a bigint, b bigint")


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set, with its smallest doc_id as ``rep``.

    Only sets whose key shares a cell with another row's are gathered; a row alone in its cell is a class by itself, and its
    prefix is not shuffled.
    """
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    twice = full.select(_cell("k1", KEY_BITS).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = signed.sparkSession.sparkContext.broadcast(bit_table(twice.select("cell"), KEY_BITS))

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("k1").to_numpy() & ((1 << KEY_BITS) - 1)
                yield batch.filter(pa.array(is_set(shared.value, cells) == wanted))

        return full.mapInArrow(run, full.schema)

    alone = split(False).select("k1", "k2", F.col("doc_id").alias("rep"), "n", "prefix", "bins")
    several = (
        split(True).groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"))
    )
    return alone.unionByName(several)


def _shared_posts(classes: DataFrame) -> DataFrame:
    """``gram``, ``rep``, ``n``, ``pos``, ``low``, ``high`` of the prefix n-grams that several classes have.

    Two shuffles: of n-grams with their smallest and largest class, and of those rows alone whose n-gram
    is, by a bit table, one of several classes.
    """
    posts = classes.select("rep", F.explode("prefix").alias("gram"))
    shared = stored(posts.groupBy("gram").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"), "shared")
    bits = classes.sparkSession.sparkContext.broadcast(bit_table(shared.select(_cell("gram", GRAM_BITS).alias("cell")), GRAM_BITS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            begins = prefix.offsets.to_numpy()
            grams = prefix.values.to_numpy()[begins[0] : begins[-1]]
            counts = np.diff(begins)
            row = np.repeat(np.arange(batch.num_rows), counts)
            pos = np.arange(len(grams)) - np.repeat(begins[:-1] - begins[0], counts)
            met = np.flatnonzero(is_set(bits.value, grams & ((1 << GRAM_BITS) - 1)))
            at = pa.array(row[met])
            yield pa.RecordBatch.from_arrays([pa.array(grams[met]), batch.column("rep").take(at), batch.column("n").take(at), pa.array(pos[met].astype(np.int32))], ["gram", "rep", "n", "pos"])

    some = classes.select("rep", "n", "prefix").mapInArrow(keep, "gram bigint, rep bigint, n bigint, pos int")
    return some.join(shared, "gram")


def _one_document(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id``, ``rep`` for every class of the doc_ids that stand in rows with different sets."""
    several = sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("u"), F.max(F.struct("k1", "k2")).alias("v")).where("u <> v")
    mine = sized.where("n > 0").join(several.select("doc_id"), "doc_id").select("doc_id", "k1", "k2").distinct()
    return mine.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")


def similarity_groups(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Texts are
    lower-cased (A-Z) and cut at white space. Null and empty texts have an empty set and stand
    alone. Rows with equal text are one class. Rows that share a doc_id are one document that
    links wherever one of its texts does. A row without doc_id takes no part: its component is
    null. Other columns are not looked at. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    with scope():
        with scope():  # what was signed goes once classes are known
            signed = stored(signatures(docs, rule, frequencies(docs, rule)), "signed")
            classes = kept(_classes(signed), "classes")
            sized = kept(signed.select("doc_id", "n", "k1", "k2"), "sized")
        same = stored(_one_document(sized, classes), "same")
        with scope():
            group = kept(_shared_posts(classes), "groups")
        plain = group.groupBy("gram").agg(F.min_by("rep", "pos").alias("plain"))
        lead = F.explode(F.array_distinct(F.array("low", "high", "plain")))
        first = group.join(plain, "gram").select("rep", lead.alias("lead")).where("rep <> lead")
        first = first.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
        first = stored(_possible(first, classes, rule), "first")
        links = _verified(first, docs, rule)
        least = same.groupBy("doc_id").agg(F.min("rep").alias("a"))
        tied = same.join(least, "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))
        near = components(stored(links.unionByName(tied), "links"))
        placed = group.select("gram", "rep", "n", "pos").join(near.toDF("rep", "place"), "rep", "left")
        placed = placed.withColumn("place", F.coalesce("place", "rep"))
        open_ = placed.groupBy("gram").agg(F.min("place").alias("u"), F.max("place").alias("v")).where("u < v")
        placed = stored(placed.join(open_.select("gram"), "gram"), "placed")
        a, b = placed.alias("a"), placed.alias("b")
        enough = f"ceil({rule.num} * (a.n + b.n) / {rule.num + rule.den}D)"
        rest = a.join(
            b,
            F.expr(
                "a.gram = b.gram AND a.rep < b.rep AND a.place <> b.place"
                f" AND {rule.den} * least(a.n, b.n) >= {rule.num} * greatest(a.n, b.n)"
                f" AND 1 + least(a.n - a.pos, b.n - b.pos) - 1 >= {enough} - 0.5"
            ),
        ).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        rest = stored(_possible(rest.distinct(), classes, rule).exceptAll(first), "rest")
        late = stored(_verified(rest, docs, rule), "late")
        whole = near if late.isEmpty() else components(near.toDF("a", "b").where("a <> b").union(late))
        lone = "n = 0 OR doc_id IS NULL"
        joined = (
            sized.where(f"NOT ({lone})")
            .join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
            .join(whole.toDF("rep", "component"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        )
        # an empty text is where the other texts of its document are, if there are any
        known = same.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(whole.toDF("rep", "component"), "rep", "left")
        known = known.select("doc_id", F.coalesce("component", "rep").alias("known"))
        alone = sized.where(lone).join(known, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("known", "doc_id").alias("component_id"))
        return kept(joined.unionByName(alone), "similar")

"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Every run of ``window`` words is covered by ``window - gram + 1`` word ``gram``-grams; the smallest
of their hashes is a fingerprint. Two texts that share ``window`` consecutive words share all
those hashes, hence the fingerprint: no shared window is missed. Fingerprints of the documents are
joined with those of the test items, and where they meet the hit is extended: all windows of the
document are compared with all windows of the items, and hits that touch become spans.

Items shorter than ``window`` words have one window, the item itself. Nothing sparser than all runs
of that length is sure to meet it, so for each such length the documents give all their runs.

Words and runs are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwise.shared import kept, scope, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Sides of joins with no more rows than this are broadcast; others are shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Windows:
    window: int = 10
    gram: int = 5


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) words: letters, digits and everything outside ASCII. Null gives none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _runs(hashes: str, length: int) -> Column:
    """The hashes of all runs of ``length`` words."""
    h = F.col(hashes)
    at = F.sequence(F.lit(0), F.size(h) - length)
    each = F.transform(at, lambda i: F.xxhash64(F.lit(length), *(h[i + j] for j in range(length))))
    return F.when(F.size(h) >= length, each).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: str, length: int) -> Column:
    """The runs with their word numbers."""
    return F.transform(
        _runs(hashes, length),
        lambda run, i: F.struct(i.alias("start"), (i + length).alias("stop"), run.alias("run")),
    )


def _smallest(grams: str, width: int) -> Column:
    """The distinct smallest values of ``width`` consecutive ones."""
    g = F.col(grams)
    at = F.sequence(F.lit(0), F.size(g) - width)
    each = F.transform(at, lambda i: F.least(*(g[i + j] for j in range(width))))
    return F.when(F.size(g) >= width, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("words", word_list(F.col("text"))).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w))
    )


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be small enough, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``mark``, ``n_words``, ``n_hit``, ``spans``, ``items``.

    ``n_hit`` words lie inside an occurrence of a window of ``items`` (item_id, text); ``spans`` are the
    maximal runs of such words (``start``, ``stop``: word numbers); ``items`` are the ids, as sorted
    strings, whose windows occur. Null and empty texts have no words and no hits. Repeated rows get
    equal results; ``mark`` is the hash of the text and tells rows apart that share a doc_id, or have
    none. An item without words has no window; one without id counts as id "". An id that
    several items share is one item. Other columns are not looked at.
    """
    width = rule.window - rule.gram + 1
    same_row = ["doc_id", "mark"]

    def on_row(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])

    with scope():
        asked = stored(
            _hashed(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"))
            .withColumn("n", F.size("words")).where("n > 0").drop("text", "words"),
            "items",
        )
        short = sorted(r["n"] for r in asked.where(F.col("n") < rule.window).select("n").distinct().collect())
        lengths = [*short, rule.window]
        whole = reduce(lambda c, n: c.when(F.col("n") == n, _runs("hashes", n)), short, F.when(F.lit(False), F.array().cast("array<bigint>")))
        runs = asked.select("item", F.least("n", F.lit(rule.window)).alias("length"), F.explode(whole.otherwise(_runs("hashes", rule.window))).alias("run"))
        runs = stored(runs.groupBy("run", "length").agg(F.collect_set("item").alias("found")), "runs")
        prints = (
            asked.withColumn("grams", _runs("hashes", rule.gram))
            .select(F.explode(whole.otherwise(_smallest("grams", width))).alias("print")).distinct()
        )
        prints = stored(prints, "prints")

        texts = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
        own = F.array(F.xxhash64("doc_id", "mark"))
        cut = _hashed(texts).withColumn("grams", _runs("hashes", rule.gram))
        marks = F.concat(own, _smallest("grams", width), *(_runs("hashes", n) for n in short))
        each = cut.select(*same_row, F.size("words").cast("bigint").alias("n_words"), F.posexplode(marks).alias("at", "print"))
        side = small(prints).withColumn("meets", F.lit(True))
        seen = stored(
            each.join(side, "print", "left").where("at = 0 OR meets").select(*same_row, "n_words", (F.col("at") == 0).alias("row")),
            "seen",
        )
        hits = stored(seen.where("NOT row").select(*same_row).distinct(), "hits")
        near = texts.join(small(hits), on_row(texts, hits), "left_semi").dropDuplicates(same_row)
        every = F.flatten(F.array(*(_placed("hashes", n) for n in lengths)))
        spots = _hashed(near).select(*same_row, F.explode(every).alias("w")).select(*same_row, "w.*")
        spots = stored(spots.join(small(runs), "run").select(*same_row, "start", "stop", "found"), "spots")

        order = "PARTITION BY doc_id, mark ORDER BY start, stop ROWS BETWEEN"
        laid = (
            spots.select(*same_row, "start", "stop")
            .withColumn("before", F.expr(f"max(stop) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING)"))
            .withColumn("opens", F.expr("CAST(before IS NULL OR start > before AS INT)"))
            .withColumn("no", F.expr(f"sum(opens) OVER ({order} UNBOUNDED PRECEDING AND CURRENT ROW)"))
            .groupBy(*same_row, "no").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .groupBy(*same_row).agg(
                F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("n_hit"),
                F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
            )
        )
        named = (
            spots.select(*same_row, F.explode("found").alias("item")).distinct()
            .groupBy(*same_row).agg(F.array_sort(F.collect_list("item")).alias("items"))
        )
        found = stored(laid.join(named, on_row(laid, named)).select(laid["doc_id"], laid["mark"], "n_hit", "spans", "items"), "found")
        rows = seen.where("row")
        result = rows.join(found, on_row(rows, found), "left").select(
            rows["doc_id"], rows["mark"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        return kept(result, "contaminated")


def without_hits(docs: DataFrame, items: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of ``items`` occurs; only the keys of the
    others are stored."""
    with scope():
        bad = kept(decontaminate(docs, items, rule).where("n_hit > 0").select("doc_id", "mark").distinct(), "bad")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["mark"])
    return docs.join(small(bad), same, "left_anti")


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

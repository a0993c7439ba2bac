"""Toxicity by multiple-instance learning: labels say which documents, not which sentences.

Every sentence gets a probability from a linear model on its words and on the beginnings of its
words; a document is toxic unless all its sentences are harmless (noisy-or):
``P = 1 - prod(1 - p_sentence)``. The loss is taken on ``P`` alone, so the fit itself finds the
sentences that explain the labels, and the largest ``p_sentence`` locates them afterwards.

The evidence per feature is counted over the labelled rows by all executors into a table of fixed
size; the features that tell the classes apart are kept; one task fits their weights. ``fit_rows``
bounds the labelled rows that a classifier is fitted on. Scoring reads every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwise.llm.kernel import ALNUM, Words, slices, text_bytes, words
from fleetwise.shared import scope, stored

CUT = np.zeros(256, bool)
CUT[[10, 33, 46, 63]] = True  # new line ! . ?
STARTS = (4, 5, 6, 7)  # bytes of a word's beginning that count as features, beside the whole word


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled rows used; ``slots`` hashed features, ``kept`` weights."""

    fit_rows: int = 100_000
    slots: int = 1 << 18
    kept: int = 4096
    steps: int = 250
    rate: float = 0.1
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per slot
    bias: float


def _features(found: Words, slots: int) -> np.ndarray:
    """One row per word: its slots."""
    mask = np.uint64(slots - 1)
    columns = [found.prefix() & mask]
    for n in STARTS:
        columns.append((found.prefix(n) + np.uint64(n * 0x9E3779B1)) & mask)
    return np.stack(columns, 1).astype(np.int32)


def _sentences(found: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its document and its sentence (numbered over the slice); per sentence its document."""
    doc = np.repeat(np.arange(n_texts), np.diff(found.first))
    before = np.cumsum(CUT[found.data])[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) > 0) | (np.diff(before) > 0)
    return doc, np.cumsum(new) - 1, doc[new]


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of at most ``fit_rows`` labelled documents, by hash."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def evidence(train: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per label 0 and 1: documents in which each feature occurs, and documents at all."""
    slots = settings.slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, slots), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch):
                label = (part.column("toxic").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
                found = words(part.column("text"), ALNUM)
                grid = _features(found, slots).astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(found.first))
                once = np.unique((doc[:, None] * slots + grid).ravel())
                np.add.at(seen, (label[once // slots], once % slots), 1)
                rows += np.bincount(label, minlength=2)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, slots)), pa.array(np.append(seen[0, at], rows[0])), pa.array(np.append(seen[1, at], rows[1]))],
            ["slot", "clean", "toxic"],
        )

    sums = (
        train.mapInArrow(count, "slot bigint, clean bigint, toxic bigint")
        .groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    )
    out = np.zeros((2, slots + 1), np.int64)
    at = sums.column("slot").to_numpy()
    out[0, at], out[1, at] = sums.column("clean").to_numpy(), sums.column("toxic").to_numpy()
    return out[:, :slots], out[:, slots]


def _chosen(seen: np.ndarray, rows: np.ndarray, kept: int) -> np.ndarray:
    """The slots that tell the labels apart best: log odds over 1, most standard errors (over 3)."""
    a, b = seen[1] + 0.5, seen[0] + 0.5
    odds = np.log(a / (rows[1] + 1 - seen[1] + 0.5)) - np.log(b / (rows[0] + 1 - seen[0] + 0.5))
    z = np.where(np.abs(odds) > 1, np.abs(odds) / np.sqrt(1 / a + 1 / b), 0.0)
    best = np.argsort(-z, kind="stable")[:kept]
    return np.sort(best[z[best] > 3])


def _descend(y, plain, owner, sentence, feature, n_features, settings) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or loss. ``plain``: sentences without features, per document; ``owner``: the
    document of each other sentence; ``sentence``, ``feature``: of each occurrence."""
    w = np.zeros(n_features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_sentences, n_docs = len(owner), len(y)
    for step in range(1, settings.steps + 1):
        z = np.clip(np.bincount(sentence, w[feature], minlength=n_sentences) + w[-1], -500, 500)
        harm = np.bincount(owner, np.logaddexp(0, z), minlength=n_docs) + plain * np.logaddexp(0, w[-1])
        slope = np.where(y > 0, -1 / np.expm1(np.clip(harm, 1e-9, 500)), 1.0)
        back = slope[owner] / (1 + np.exp(-z))
        at_bias = back.sum() + (slope * plain).sum() / (1 + np.exp(-w[-1]))
        g = np.append(np.bincount(feature, back[sentence], minlength=n_features), at_bias) / n_docs
        g[:-1] += settings.ridge * w[:-1] / np.sqrt(n_docs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks.

    A document that is labelled twice counts as toxic if one label says so. Rows whose doc_id or
    label is null are not learned from. Without rows of both labels, every sentence gets the same
    small probability.
    """
    flat = Model(np.zeros(settings.slots, np.float32), -20.0)
    with scope():
        train = stored(labelled(docs, labels, settings), "labelled")
        seen, rows = evidence(train, settings)
        if rows.min() == 0:
            return flat
        chosen = _chosen(seen, rows, settings.kept)
        place = np.full(settings.slots, -1, np.int32)
        place[chosen] = np.arange(len(chosen))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = words(part.column("text"), ALNUM)
                    doc, sentence, owner = _sentences(found, part.num_rows)
                    at = place[_features(found, settings.slots)]
                    word, _ = np.nonzero(at >= 0)
                    value, nos, of = at[at >= 0], sentence[word], doc[word]
                    cut = np.searchsorted(of, np.arange(part.num_rows + 1))
                    first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                    lists = [
                        (value[a:b].tolist(), (nos[a:b] - f).tolist())
                        for a, b, f in zip(cut[:-1], cut[1:], first[:-1], strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), (part.column("toxic")).cast(pa.int32()), pa.array(np.maximum(np.diff(first), 1).astype(np.int32)),
                         pa.array([x[0] for x in lists], pa.list_(pa.int32())), pa.array([x[1] for x in lists], pa.list_(pa.int32()))],
                        ["doc_id", "toxic", "n", "feature", "sentence"],
                    )

        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("doc_id", kind="stable")
            n, sizes = rows.n.to_numpy().astype(np.int64), rows.feature.map(len).to_numpy()
            start = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(rows)), sizes)
            flat_of = lambda c: np.concatenate([np.asarray(x, np.int64) for x in rows[c]])
            held, sentence = np.unique(start[doc] + flat_of("sentence"), return_inverse=True)
            owner = np.searchsorted(start, held, side="right") - 1
            plain = n - np.bincount(owner, minlength=len(rows))
            w, b = _descend((rows.toxic > 0).to_numpy(), plain, owner, sentence, flat_of("feature"), len(chosen), settings)
            return pd.DataFrame({"place": np.arange(len(w) + 1), "weight": np.append(w, b)})

        kind = "doc_id bigint, toxic int, n int, feature array<int>, sentence array<int>"
        whole = train.mapInArrow(extract, kind).withColumn("all", F.lit(0)).groupBy("all")
        got = whole.applyInPandas(learn, "place int, weight double").toPandas()
    weights = np.zeros(settings.slots, np.float32)
    by_place = got.sort_values("place").weight.to_numpy()
    weights[chosen] = by_place[:-1]
    return Model(weights, float(by_place[-1]))


def _sentence_odds(part: pa.RecordBatch, model: Model):
    """Words, sentence of each word, document and log-odds of each sentence, probability per row."""
    found = words(part.column("text"), ALNUM)
    _, sentence, owner = _sentences(found, part.num_rows)
    by_word = model.weights[_features(found, len(model.weights))].sum(1, dtype=np.float64)
    z = np.bincount(sentence, by_word, minlength=len(owner)) + model.bias
    harm = np.bincount(owner, np.logaddexp(0, z), minlength=part.num_rows).astype(np.float64)
    harm[np.diff(found.first) == 0] = np.logaddexp(0, model.bias)
    return found, sentence, owner, z, -np.expm1(-harm)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_sentence_odds(part, shared.value)[-1] < 0.5))

    return docs.mapInArrow(passing, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted``, ``worst`` for every row.

    ``worst`` is the sentence with the highest probability where the document is predicted toxic,
    else null; of equal sentences the first. A null or empty text counts as one sentence without
    words. Repeated rows are scored alike. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, sentence, owner, z, p = _sentence_odds(part, shared.value)
                raw, _ = text_bytes(part.column("text"))
                bare = np.diff(found.first) == 0
                opens = np.searchsorted(sentence, np.arange(len(owner) + 1))
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                worst: list[str | None] = [None] * part.num_rows
                for i in np.flatnonzero((p >= 0.5) & ~bare):
                    s = first[i] + int(np.argmax(z[first[i] : first[i + 1]]))
                    a, b = found.starts[opens[s]], found.ends[opens[s + 1] - 1]
                    worst[i] = raw[a:b].tobytes().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(worst, pa.string())],
                    ["doc_id", "score", "predicted", "worst"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        judge, "doc_id bigint, score double, predicted int, worst string"
    )

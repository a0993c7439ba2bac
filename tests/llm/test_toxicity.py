import random

import pytest
from cases import AWKWARD, documents, sentence, with_clashes

from fleetwise.llm import toxicity


def corpus(seed, n):
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(n):
        parts = [sentence(rng, 12, 300) for _ in range(rng.randrange(1, 9))]
        labels[i] = int(rng.random() < 0.2)
        if labels[i]:
            bad = rng.choice(["vile", "vilest", "grubworm", "grubby"])
            at = rng.randrange(len(parts))
            parts[at] = f"w1 {bad} w2 {bad}"
        rows.append((i, ". ".join(parts)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1, 600)
    table = with_clashes(spark.createDataFrame([(i, y) for i, y in labels.items() if i % 2] + [(None, 1), (1, labels[1]), (3, None)], "doc_id bigint, toxic int"))
    return toxicity.fit(documents(spark, rows + AWKWARD), table), rows, labels


def test_held_out_documents_and_the_sentence(spark, fitted):
    model, rows, labels = fitted
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows), model).collect()}
    held = [i for i in labels if i % 2 == 0]
    right = sum(got[i].predicted == labels[i] for i in held)
    assert right >= 0.98 * len(held)
    found = [got[i].worst for i in held if labels[i] and got[i].predicted]
    assert found and all("vile" in w or "grub" in w for w in found)
    assert all(got[i].worst is None for i in held if not got[i].predicted)


def test_score_is_the_noisy_or_of_sentences(spark, fitted):
    model, _, _ = fitted
    one = [(1, "w1 vile w2"), (2, "w3 w4"), (3, "w1 vile w2. w3 w4"), (4, "w3 w4! w1 vile w2")]
    p = {r.doc_id: r.score for r in toxicity.score(documents(spark, one), model).collect()}
    assert p[3] == pytest.approx(1 - (1 - p[1]) * (1 - p[2])) == pytest.approx(p[4])


def test_awkward_rows(spark, fitted):
    model, _, _ = fitted
    got = toxicity.score(documents(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[9001] == by_id[9002] == by_id[9003] > 0
    docs = documents(spark, [*AWKWARD, (1, "w1 vile vile w2")])
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b"), (2, "c d")])
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all(r.predicted == 0 and r.score > 0 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_the_bound_on_fitted_rows(spark):
    rows, labels = corpus(2, 60)
    table = spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")
    some = toxicity.labelled(documents(spark, rows), table, toxicity.Settings(fit_rows=20))
    assert some.count() == 20

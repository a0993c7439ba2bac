import random

import corpus_pipeline
from cases import AWKWARD, documents, edited, sentence
from compare import connect, differences

from fleetwise.llm import pieces
from fleetwise.llm.queries import ORACLE_SQL, PIECES, QUERIES


def test_planted_documents_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(1)
    rows, toxic, bench = [], {}, [(i, sentence(rng, 20)) for i in range(6)]
    clean = {}
    for i in range(400):
        text = sentence(rng, rng.randrange(30, 90))
        toxic[i] = int(i % 10 == 0)
        if toxic[i]:
            text = text.replace(" ", " scum. ", 3)
        else:
            clean[i] = text
        rows.append((i, text))
    copies = {1000 + i: edited(rng, clean[i], i % 2) for i in (1, 2, 3, 11, 12)}
    hits = {2000 + i: sentence(rng, 30) + " " + b + " " + sentence(rng, 30) for i, b in bench}
    rows += [*copies.items(), *hits.items(), *AWKWARD]
    folder = str(tmp_path)
    documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    want = sorted([*clean, *(d for d, _ in AWKWARD if d != 9005)], key=str)
    assert sorted((r.doc_id for r in got), key=str) == want  # 9005 equals 9004 but for its case
    vocabulary = pieces.load(PIECES)
    some = [r for r in got if r.doc_id in clean][:20]
    for r in some:
        marked = pieces.WORD.findall(pieces.mark(clean[r.doc_id]))
        own = pieces.segment(set(marked), vocabulary)
        assert tuple(r.token_ids) == tuple(i for w in marked for i in own[w])


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).schema == docs.schema


def test_queries_equal_their_sql(spark, middle):
    con = connect(middle)
    for name in ("op1_ngram_jaccard_join", "op2_exact_top_k", "op4_benchmark_decontamination"):
        assert differences(QUERIES[name](spark, middle).toPandas(), con.sql(ORACLE_SQL[name]).df()) == [], name


def test_scratch_tables_go(spark, small):
    import os

    from fleetwise.shared import scope, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scope():
        for name in ("op1_ngram_jaccard_join", "op4_benchmark_decontamination", "op5_lm_scoring", "op10_toxicity"):
            QUERIES[name](spark, small).count()
    assert set(os.listdir(folder)) == before

"""From raw documents to token ids: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwise.llm import jaccard, pieces, toxicity, winnow
from fleetwise.llm.queries import PIECES
from fleetwise.shared import kept, scope, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, fitted on the labelled ones among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word n-grams, similarity 0.8).

    The smallest doc_id of a group stays; of rows that share it, those with that doc_id. Rows
    without doc_id, and rows without text, belong to no group and stay.
    """
    with scope():
        groups = jaccard.similarity_groups(docs, jaccard.Similarity(words=5, num=4, den=5))
        gone = kept(groups.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(winnow.small(gone), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of ten consecutive words of a benchmark item occurs."""
    return winnow.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; whole texts, one row for every row."""
    tokens = pieces.encode(docs, pieces.load(PIECES), keep=("doc_id", "lang", "source", "n_chars"))
    return tokens.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("piece_encoding", encoded),
]

# The first and the last stage have no SQL; tests compare the whole with a brute-force version.

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope():
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        return kept(STAGES[-1][1](spark, docs, sf_dir), "pipeline")

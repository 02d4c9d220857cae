"""A training corpus from raw documents: each stage calls one operator of wayfield.llm on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import bpe, exact, mixing, near, quality_model
from wayfield.llm.shared import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; it is fitted on labelled documents of the whole table."""
    return quality_model.selected(docs, quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("__rating")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.drop_duplicates(docs)


def distinct_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least doc_id."""
    return near.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of a source that has a token, those of sources below their target weight more than once."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mixture holds."""
    return bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("tokens").alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", distinct_near),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: Fitted weights and byte-pair merges have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs

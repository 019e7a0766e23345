"""A training corpus from ``documents``: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import language_id, mixing, quality, simhash, unigram
from pairlens.llm.common import durable, read, temporary
from pairlens.llm.queries import pieces


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.accepted(docs, language_id.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return unigram.encode(docs, pieces(spark))


STAGES = [("language ID", languages), ("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("mixing", mixed), ("SentencePiece encoding", tokens)]
#: Trained models and vocabularies are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with temporary(spark):  # what a stage writes on its way goes when its result is there
            docs = durable(stage(spark, docs, sf_dir), keep=True)
    return docs

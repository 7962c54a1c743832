"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept, written as Parquet and read again. Toxicity and
quality are learned from the labels table, as far as it labels documents still there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecrest.llm import mixing, packing, quality, similar, simhash, toxicity
from pagecrest.llm.common import fresh, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grammar score stays below one half."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxic_score")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: texts whose five-word
    shingles have a Jaccard similarity of 0.8 or more, and chains of such pairs."""
    return simhash.keep_first(docs, similar.dedup_groups(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: documents taken twice are there twice, and one that is taken
    in part is there with its first words."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024), capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_bad_quality),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned models, BK-trees and token ids have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = settle(docs)
    return docs

"""Corpus pipeline over ``documents``: each stage reads what the stage before it kept.

Language identification, toxicity, near duplicates, benchmark decontamination, packing.  All
stages but the last return the columns of ``documents``; the last returns training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoreel.llm import decontam, langid, minhash, packing, toxicity
from chronoreel.llm._io import Scratch, read_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from ``docs``."""
    return langid.keep_known(docs, langid.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain learned from ``labels`` does not call toxic."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs, k=5, threshold=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; those that are mostly such passages go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of everything kept: one row a piece, with its token ids."""
    return packing.public_pieces(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned models, minima and tokenisation are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

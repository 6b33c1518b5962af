"""Corpus pipeline: ``documents`` to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
documents for all but the last, the packed pieces for the last. ``run`` writes
each stage's result to the shared checkpoint folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import exact, langid, mixing, neardup, packing
from ledgerline.llm.common import c, cut
from ledgerline.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose bytes a learned language codes in fewer than 8 bits each; those
    without a letter, or text, go. With nothing learned, all with a letter stay."""
    trees = langid.learn(docs.where(~langid.held_out()))
    lettered = F.coalesce(c("text").rlike(r"\p{L}"), F.lit(False))
    unlike = langid.unlike_any(spark, trees)
    return docs.where(lettered).withColumn("_unlike", unlike(c("text"))).where(~F.col("_unlike")).select(
        *[c(n) for n in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space only."""
    return exact.keep_one_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8 or more)."""
    return neardup.keep_one_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, each with its place in a sequence. A small store of
    words: executors still hold what the stages before have taken."""
    return packing.pack_documents(docs, capacity=2048, end_id=0, stored_runs=50_000, chars=400_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# SQL cannot express language ID or packing; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

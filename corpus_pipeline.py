"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Language ID drops the documents it rejects; line dedup takes repeated lines out of the texts; near-dedup keeps the
smallest doc_id of each class; mixing repeats or drops documents towards its sources' targets; packing puts out pieces
of sequences.  Every stage but the last returns exactly the columns of its input.

Defined results: a null text, or one without a letter, is rejected by the first stage; a text that loses all its lines is
empty from there on, links with nothing and has size 0 (so the mix takes it or not by its hash alone); a null source is a
source of its own; a null doc_id is learned from and hashed as the empty text and never joins a class, and rows that
repeat a doc_id are one document of which near-dedup keeps one row; ties in language, links or thresholds go as the
operators' docstrings say; texts of any length are used whole; extra columns of any name pass through the first four
stages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almoner.llm import bagminhash, langid, linededup, mixing, packing
from almoner.llm.common import scratch_path
from almoner.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(langid.training(docs)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express language ID, near-dedup or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

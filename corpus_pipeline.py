"""Corpus cleaning pipeline: each stage is one operator; each reads what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents, other columns included, whatever their
names.  Every stage accepts an empty table, null or empty texts, null or
repeated ids and texts of any length; what it does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trekframe.llm import bpe, decontam, langid, pii, simhash
from trekframe.llm.common import stored
from trekframe.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a known language that holds at least half of their letters.

    Texts that are null, empty or without a letter have no language and go, as do
    those mostly in scripts that no labelled document is written in; of
    languages with equal shares the first in order counts; repeated rows are
    kept or go alike; with no labelled row to learn from, all go.
    """
    return langid.identify(docs, langid.train(docs), reject=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least id.

    Null and empty texts are near-duplicates of each other; of rows with equal
    ids one stays; rows without an id stand for a group only where all are
    without, the one with the least hash of its text.
    """
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule marks.

    Texts that are null, empty or without a word stay; rows with equal texts are
    dropped or stay alike; ids play no part; an empty benchmark drops nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data and the terms that disclose it; every document stays.

    Null texts stay null and empty ones empty; rows with equal id and text are
    one document to the counts and are rewritten alike; n_chars follows the text.
    """
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids and piece_offsets of every row.

    Null and empty texts have no token; null and repeated ids stay as they are.
    """
    return bpe.encode(docs.select("doc_id", "text"), VOCABULARY)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("byte_bpe", encode)]

#: Language identification and SimHash are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

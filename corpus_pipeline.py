"""The corpus pipeline: five stages over documents, each an operator of terrane.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, jaccard_join, mixing, suffix_dedup, toxicity
from terrane.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model rejects; a null or empty text has no terms, and the score of none. Repeated
    rows share their fate; all columns stay as they are."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar ones, that of the smallest id (nulls last), one row of it. Texts without
    words are in no class and all stay."""
    return jaccard_join.one_of_each(docs)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes and more that stand in several places; n_chars follows the text. No row goes, emptied ones
    neither; a null text becomes empty."""
    return suffix_dedup.without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the source mix does; a null source is one of its own. Texts without words stay once."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text, a row for each: n_tokens and digests of the ids and of the decoded bytes; a null text is
    empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", repeated_strings_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: A learned model and hashed choices: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

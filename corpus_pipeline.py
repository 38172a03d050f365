"""A training corpus from raw documents: five stages, each on all that the one before kept.

Toxic documents go, similar lines go, one document of each near-duplicate group stays,
repeated passages go, and what is left is packed into sequences. A stage that cuts texts sets
``n_chars`` anew and keeps the document, emptied or not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import hyperminhash, line_dedup, packing, suffix_dedup, toxicity
from tidegrid.llm.common import read_table, staged


def _with_columns_of(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the length of the text left."""
    return cut.select(*(F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_columns_of(docs, line_dedup.remove_similar_lines(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(docs, words=5, percent=80).where("kept").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_columns_of(docs, suffix_dedup.remove_repeats(docs, as_text=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_similar_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Trees, registers and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

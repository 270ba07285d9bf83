"""A corpus pipeline of five stages, each written as Parquet and read again as the documents of the next.

language ID -> near-duplicate removal -> pseudonyms -> mixing -> byte-level BPE

Stages return the columns of documents, whatever others there are, but for the last. Empty tables give empty tables. What a
stage does with nulls and repeated rows is said with it; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, language_id, mixing, near_dedup, pseudonyms
from tidemark.llm.queries import DEMO_KEY
from tidemark.llm.tables import table
from tidemark.sources.scratch import remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, lang being the predicted one; those with a null, empty or letter-free text go, a table without labels keeps none."""
    return language_id.keep_identified(docs, language_id.train(docs), lang_col="lang")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the least id of every near-duplicate class.

    Repeated rows of an id are one document; rows without an id are one for each text, null and empty texts too, and stay.
    """
    return near_dedup.keep_one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, personal data replaced by pseudonyms, n_chars following the text; a null text stays null."""
    return pseudonyms.with_pseudonyms(docs, DEMO_KEY, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by their calibrated probabilities: rows of one id together, as are all rows without one; texts without a word stay."""
    return mixing.sampled_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row that is left; a null text counts as empty."""
    return byte_bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Signatures, trained models and merges can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's documents are deleted once the next has been written."""
    docs = table(spark, sf_dir, "documents")
    folder, read = shared_folder(spark), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(out), out
    return docs

"""The corpus pipeline: language, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame with the columns of ``documents``, which is written and read again; the last one
returns the encoded documents: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtab.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from loomtab.llm._shared import removed, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language among those learned, go."""
    return language_id.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest stays, then the one of the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one of the smallest id stays.

    Shingles of five words and a similarity of 0.8, as near copies of documents are defined here.
    """
    return jaccard_join.keep_one_of_each(docs, words=5, least=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target proportions; documents of small, heavy sources stand twice, and all stand whole."""
    return mixing.mix(docs, whole=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: The shuffle of the mixture and the token ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's folder goes when the next one is written."""
    top = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs

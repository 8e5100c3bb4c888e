"""From raw documents to a tokenized training mix, in five stages.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.

Defined results: documents whose language cannot be told go, and a null language becomes the predicted one; copies of a
document with a smaller id go; secrets are masked in the text (and ``n_chars`` follows); documents come as often as the
mix takes them, not at all if it does not; the last stage has one row for each of these rows, with its ids and the text
they decode to. Nulls, empty tables and further columns pass as the operators of each stage define.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import byte_bpe, language_id, mixing, secret_scan, simhash_dedup
from voxframe.session import shared_folder


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", tell_language),
    ("SimHash near-dedup", drop_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

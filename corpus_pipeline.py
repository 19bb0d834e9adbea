"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

1. quality: documents that the classifier scores below 0.3 go.
2. near_duplicates: of each class of five-word-shingle sets linked at a similarity of 0.8, the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: secrets in the texts are masked; no document goes.
5. tokens: texts become token ids.

All but the last return the columns of documents. Rows with null or empty texts pass where no stage has a reason against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import bpe, decontam, jaccard, quality, secrets
from genoloom.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on this input's labelled documents, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class of near copies."""
    return jaccard.keep_first(docs, k=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked and n_chars brought up to date."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of all rows."""
    return bpe.encode_documents(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secrets", masked_secrets),
    ("tokens", token_ids),
]

#: Ridge regression, components of a graph and byte-pair merges are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

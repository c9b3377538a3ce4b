"""From documents to tokens: reject poor texts, drop near duplicates, hide personal data, mix sources,
encode. Each stage works on what its predecessor kept; all but the last return the columns of documents."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from portcullis.llm import bpe, knn_quality, mixing, ngram_join, pii
from portcullis.llm.queries import PII_KEY, QUALITY_THRESHOLD
from portcullis.session import checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return knn_quality.accepted(docs, model, QUALITY_THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; they keep their length, so n_chars stays right."""
    return pii.hidden(docs, PII_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of each document, digested, and the digest of the decoded text."""
    return bpe.digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mix", mixed), ("tokens", tokens)]

#: SQL states neither the classifier nor the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Defined results of every stage: an empty table gives no rows; nulls in any column are passed on, a null or empty text failing the first
stage's base rules; rows repeated with id and text are one after the second stage; extra columns are passed on, whatever their names,
up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, mixing, pii, quality, queries, simhash
from weftline.llm._shared import table, write_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie far from their group's centre go."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one stays."""
    return simhash.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets."""
    return pii.redact(docs, pii.fit(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: a document may come twice or thrice, in part, or not at all."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed document, and the digest of what they decode to."""
    df = bpe.round_trip(docs, queries.vocabulary(), ["doc_id", "lang", "source"])
    return df.selectExpr("doc_id", "lang", "source", "cast(size(ids) as bigint) as n_tokens", "ids", "sha2(bytes, 256) as decoded_sha256")


STAGES = [("quality", good_quality), ("simhash", one_of_each), ("pii", without_personal_data), ("mixing", mixed), ("bpe", tokens)]

#: SQL can express none of these stages whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs

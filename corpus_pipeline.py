"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next one's docs. All but the last return the columns of documents. Rows with a null
doc_id can't be named in a decision, so they pass the dropping stages; rows that share a doc_id
stand or fall together. Null and empty texts fail the quality rules. An empty table stays empty
through all stages, and columns beside those of documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import bpe, decontaminate, neardup, quality, secret_scan
from ruleloom.llm.common import table, without, written
from ruleloom.llm.queries import tokenizer_json

#: The secret redaction and the tokenizer are beyond SQL, so there is none; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return without(spark, docs, quality.verdicts(spark, docs).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: sets of five words, similarity 0.8."""
    return without(spark, docs, neardup.groups(spark, docs, shingle_words=5, percent=80).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(spark, docs, decontaminate.leaks(spark, docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; null and empty texts stay as they are, and so do ids, repeated or null."""
    return secret_scan.redact(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers); a row for each row, null ids and texts (no tokens) too."""
    return bpe.encode_documents(docs, tokenizer_json("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

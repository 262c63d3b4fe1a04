"""Encoded triples, dictionaries, deltas, queries and lookup requests as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DICTIONARY, STORED, TRIPLE


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Stored triples. Files without step, cnt or is_explicit hold explicit facts."""
    found = spark.read.parquet(path)
    have = set(found.columns)
    defaults = {"step": F.lit(0), "cnt": F.lit(1), "is_explicit": F.lit(True)}
    kinds = dict(c.rsplit(" ", 1) for c in STORED.split(", "))
    return found.select(*[(F.col(c) if c in have else defaults[c]).cast(kind).alias(c) for c, kind in kinds.items()])


def write_triples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    triples.write.mode(mode).parquet(path)


def read_number_text(spark: SparkSession, path: str) -> DataFrame:
    """Triples of ids as text, ``s p o`` on a line."""
    return spark.read.schema(TRIPLE).option("sep", " ").csv(path)


def read_dictionary(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """(id, term); with ``below`` only the ids under it (standard and popular terms are under 200)."""
    found = spark.read.schema(DICTIONARY).parquet(path)
    return found if below is None else found.filter(F.col("id") < below)


def read_delta(spark: SparkSession, path: str, step: int) -> DataFrame:
    """Distinct facts of an update, of a file or a folder, as of this step; a stored step is not used."""
    return spark.read.parquet(path).select("s", "p", "o").distinct().withColumn("step", F.lit(step))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(qid, s, p, o): one pattern a line, -1 for any value; qid ascends in file order."""
    parts = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("qid"), F.split(F.trim("value"), r"\s+").alias("t")
    )
    return parts.filter(F.size("t") == 3).select(
        "qid", *[F.col("t")[k].cast("bigint").alias(c) for k, c in enumerate(("s", "p", "o"))]
    )


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """(term, pos): tab-separated, pos is S, P or O."""
    return spark.read.schema("term string, pos string").option("sep", "\t").option("quote", "").csv(path)


def append_answers(rows: DataFrame, path: str) -> None:
    """Answers as gzipped text, added to what is there."""
    rows.select(F.concat_ws(" ", *rows.columns)).write.mode("append").option("compression", "gzip").text(path)

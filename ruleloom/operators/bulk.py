"""Encoding and decoding of graphs that are too large for shuffles of text: tables are dealt into buckets once for each key.

The input is read once for the triples and once for what occurs often. Subjects are looked up where their triples lie,
objects after one deal by object; decoding deals by the ids. Ids are unique and the same for the same input files, but follow the buckets
and leave gaps between them, other than those of ``dictionary.build``, which sorts all terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import FIRST_OTHER, standard_terms
from ..model import SPO
from ..sources.lineage import dealt, fits, fresh_path, planned_bytes, removed, written
from .dictionary import BROADCAST_TERMS, high_water, popular_terms

#: Estimated bytes of input for each bucket, so that a bucket's terms fit in a task's memory, and how many buckets there
#: are at most (beyond that each one is larger). Each task writes a file for each bucket.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1024


@dataclass
class Coded:
    """Encoded distinct triples, the dictionary in buckets by id, and the part of it that is broadcast.

    ``keyed`` triples are (s, p, near, key) in buckets by ``key``: the object is ``near`` if that is not null, else ``key``,
    which is below 0 if there is no object either.
    """

    keyed: DataFrame
    names: DataFrame
    near: DataFrame
    buckets: int

    @property
    def triples(self) -> DataFrame:
        """(s, p, o), ids."""
        return self.keyed.select("s", "p", F.coalesce("near", F.when(F.col("key") >= 0, F.col("key"))).alias("o"))


def _hashed(table: DataFrame) -> DataFrame:
    """Buckets of a dictionary are small enough for hash tables, so triples needn't be sorted."""
    return table.hint("shuffle_hash")


def _apart(found: Column, key: Column, text: bool) -> Column:
    """The key that a row is dealt by: its own, or one of many that no term has, if it needs no look-up."""
    spread = F.pmod(F.xxhash64("s", "p"), F.lit(1 << 12))
    return F.when(found.isNull() & key.isNotNull(), key).otherwise(F.concat(F.lit("\0"), spread.cast("string")) if text else -2 - spread)


def _near(near: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return F.broadcast(near.select(F.col(key).alias(column), F.col(value).alias(f"_{column}")))


def near_terms(triples: DataFrame, threshold: int | None) -> DataFrame | None:
    """(id, term) of standard terms, predicates, and objects and predicates that occur more than ``threshold`` times as
    read, repeats included; None if there are too many predicates to be broadcast."""
    spark = triples.sparkSession
    predicates = written(triples.groupBy(F.col("p").alias("term")).agg(F.count("*").alias("n")).dropna(), "predicates")
    if not fits(predicates, BROADCAST_TERMS):
        return None
    base = standard_terms(spark)
    if threshold is not None:
        objects = triples.groupBy(F.col("o").alias("term")).agg(F.count("*").alias("n")).dropna()
        both = objects.unionByName(predicates).groupBy("term").agg(F.sum("n").alias("n"))
        base = written(base.unionByName(popular_terms(triples, threshold, counts=both).select("id", "term")), "near")
    rest = predicates.join(F.broadcast(base), "term", "left_anti").select("term")
    number = F.row_number().over(Window.orderBy("term")) + F.lit(FIRST_OTHER - 1)
    return written(base.unionByName(rest.select(number.cast("bigint").alias("id"), "term")), "near")


def _numbered(terms: DataFrame, first: int) -> DataFrame:
    """(id, term) of distinct terms that lie in buckets: their place in the bucket after those of the buckets before, with gaps."""
    return terms.sortWithinPartitions("term").select((F.lit(first) + F.monotonically_increasing_id()).alias("id"), "term")


def compress(spark: SparkSession, triples: DataFrame, threshold: int | None = None, whole: DataFrame | None = None) -> Coded | None:
    """The triples encoded; None if this way doesn't suit them. ``whole`` has the same rows, but is cheaper to read with all columns."""
    near = near_terms(triples, threshold)
    if near is None:
        return None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-planned_bytes(triples) // BUCKET_BYTES), MOST_BUCKETS))
    known = F.broadcast(near.select("term"))
    rows = (triples if whole is None else whole).select(*SPO)
    text = dealt([rows.join(_near(near, "p", "term", "id"), "p", "left").select("s", F.col("_p").alias("p"), "o")], "s", buckets, "text")
    subjects = text.select(F.col("s").alias("term")).distinct().dropna().join(known, "term", "left_anti")
    path = fresh_path(spark, "terms")
    names = dealt([_numbered(subjects, high_water(near))], "term", buckets, "terms", path)
    # (s, p) as ids and the object as text, or as an id if it is near
    half = (
        text.distinct()
        .join(_hashed(names.select(F.col("term").alias("s"), F.col("id").alias("_far"))), "s", "left")
        .join(_near(near, "s", "term", "id"), "s", "left")
        .join(_near(near, "o", "term", "id"), "o", "left")
        .select(F.coalesce("_s", "_far").alias("s"), "p", F.col("_o").alias("near"), "o")
    )
    half = dealt([half.select("s", "p", "near", _apart(F.col("near"), F.col("o"), True).alias("key"))], "key", buckets, "half")
    removed(text)
    objects = half.filter("near is null and not startswith(key, '\\0')").select(F.col("key").alias("term")).distinct()
    objects = objects.join(_hashed(names.select("term")), "term", "left_anti")
    names = dealt([_numbered(objects, high_water(near.unionByName(names)))], "term", buckets, "terms", path)
    encoded = half.join(_hashed(names.select(F.col("term").alias("key"), F.col("id").alias("_far"))), "key", "left")
    keyed = dealt([encoded.select("s", "p", "near", _apart(F.col("near"), F.col("_far"), False).alias("key"))], "key", buckets, "looked-up")
    removed(half)
    by_id = dealt([names], "id", buckets, "dictionary")
    removed(names)
    return Coded(keyed, by_id, near, buckets)


def keyed(parts: list[DataFrame], near: DataFrame, buckets: int) -> DataFrame:
    """Parts of (s, p, o), ids, as ``Coded.keyed`` has them."""
    own = F.broadcast(near.select(F.col("id").alias("o"), F.col("id").alias("near")))
    flagged = [x.join(own, "o", "left").select("s", "p", "near", _apart(F.col("near"), F.col("o"), False).alias("key")) for x in parts]
    return dealt(flagged, "key", buckets, "looked-up")


def nearer(coded: Coded, ids: DataFrame) -> DataFrame:
    """What is broadcast and the terms of ``ids`` (id), unless these are too many."""
    ids = written(ids.distinct().join(F.broadcast(coded.near.select("id")), "id", "left_anti"), "ids")
    if not fits(ids, BROADCAST_TERMS):
        return coded.near
    more = written(coded.names.join(F.broadcast(ids), "id", "left_semi").select("id", "term"), "near")
    return coded.near.unionByName(more) if fits(more, BROADCAST_TERMS) else coded.near


def decode(coded: Coded) -> DataFrame:
    """The triples as text; the stored ones go."""
    names, near = coded.names, coded.near
    far = lambda: _hashed(names.select(F.col("id").alias("key"), F.col("term").alias("_far")))
    half = (
        coded.keyed.join(far(), "key", "left")
        .join(_near(near, "near", "id", "term"), "near", "left")
        .join(F.broadcast(near.select(F.col("id").alias("s"), F.col("id").alias("_s"))), "s", "left")
        .select(F.col("_s").alias("near"), _apart(F.col("_s"), F.col("s"), False).alias("key"), "p", F.coalesce("_near", "_far").alias("o"))
    )
    half = dealt([half], "key", coded.buckets, "half")
    removed(coded.keyed)
    return (
        half.join(far(), "key", "left")
        .join(_near(near, "near", "id", "term"), "near", "left")
        .join(_near(near, "p", "id", "term"), "p", "left")
        .select(F.coalesce("_near", "_far").alias("s"), F.col("_p").alias("p"), "o")
    )

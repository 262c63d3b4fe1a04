"""Dictionary encoding of text triples and its inverse.

Ids are deterministic: standard terms keep theirs, popular terms (if asked for) follow from 100 by
frequency, and all others take consecutive ids in the binary order of their text, after those that
an existing dictionary has used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import FIRST_OTHER, FIRST_POPULAR, MOST_POPULAR, standard_terms
from ..model import SPO
from ..sources.lineage import fits, in_pass, passes_for, removed, written, written_parts
from .triples import count_terms

#: Dictionary rows that may be sent to every executor at most.
BROADCAST_TERMS = 200_000


def all_terms(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array(*SPO)).alias("term")).distinct()


def ranked(terms: DataFrame, first: int, stored: list[DataFrame] | None = None) -> DataFrame:
    """(id, term): consecutive ids from ``first`` in the order of the terms; reads what it adds to ``stored``.

    Terms are dealt into ranges, numbered within their range and shifted by the sizes of the ranges
    before; no task sees more than a range.
    """
    spark = terms.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        terms.select("term").repartitionByRange(parts, "term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id()),
        "terms",
    )
    if stored is not None:
        stored.append(dealt)
    # a row for each range
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return (
        dealt.withColumn("k", number)
        .join(F.broadcast(shifts), "part")
        .select((F.lit(first - 1) + F.col("shift") + F.col("k")).cast("bigint").alias("id"), "term")
    )


def counted(triples: DataFrame, passes: int) -> DataFrame:
    """The stored table (term, n) of all terms. A frequent term is in every task, so terms are counted in passes."""
    counts = count_terms(triples, 1.0).dropna(subset=["term"])
    return written_parts([counts.filter(in_pass(k, passes, F.col("term"))) for k in range(passes)], "counts")


def popular_terms(triples: DataFrame, threshold: int, fraction: float = 1.0, counts: DataFrame | None = None) -> DataFrame:
    """(id, term, n): at most MOST_POPULAR terms that occur more often than the threshold, standard ones excluded."""
    spark = triples.sparkSession
    common = (
        (count_terms(triples, fraction) if counts is None else counts)
        .join(F.broadcast(standard_terms(spark).select("term")), "term", "left_anti")
        .filter(F.col("n") > threshold)
        .orderBy(F.col("n").desc(), "term")
        .limit(MOST_POPULAR)
    )
    number = F.row_number().over(Window.orderBy(F.col("n").desc(), "term"))
    return common.select((number + F.lit(FIRST_POPULAR - 1)).cast("bigint").alias("id"), "term", "n")


def high_water(dictionary: DataFrame) -> int:
    """The first id that is free for a new term."""
    top = dictionary.agg(F.max("id")).first()[0]
    return max(FIRST_OTHER, -1 if top is None else top + 1)


def build(
    triples: DataFrame, existing: DataFrame | None = None, threshold: int | None = None, fraction: float = 1.0, stored: list[DataFrame] | None = None, passes: int = 1
) -> DataFrame:
    """The dictionary (id, term) of the triples: ``existing`` and new ids for terms that it lacks.

    Popular ids are given out only to a first dictionary, to terms that occur more than ``threshold``
    times in a sample of ``fraction``.
    """
    spark = triples.sparkSession
    counts = counted(triples, passes) if passes > 1 else None
    if stored is not None and counts is not None:
        stored.append(counts)
    base = standard_terms(spark) if existing is None else existing.select("id", "term")
    if existing is None and threshold is not None:
        base = base.unionByName(popular_terms(triples, threshold, fraction, counts if fraction >= 1 else None).select("id", "term"))
        base = written(base, "dictionary")
    return base.unionByName(grown(triples, base, stored, counts))


def grown(triples: DataFrame, base: DataFrame, stored: list[DataFrame] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(id, term) for the terms that the dictionary ``base`` lacks."""
    terms = all_terms(triples).dropna() if counts is None else counts.select("term")
    return ranked(terms.join(base, "term", "left_anti"), high_water(base), stored)


def popular_ids(triples: DataFrame, threshold: int, fraction: float = 1.0) -> DataFrame:
    """(id, n): at most MOST_POPULAR ids that occur at least ``threshold`` times in a sample of the triples."""
    counts = count_terms(triples, fraction).filter(F.col("n") >= threshold)
    return counts.orderBy(F.col("n").desc(), "term").limit(MOST_POPULAR).select(F.col("term").alias("id"), "n")


def texts_of_ids(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, term) of the given ids (a few)."""
    return dictionary.join(F.broadcast(ids.select("id")), "id", "left_semi").select("id", "term")


def _joined(triples: DataFrame, dictionary: DataFrame, key: str, value: str, popular: DataFrame, passes: int = 1, owned: bool = False) -> DataFrame:
    """Each position looked up; ids before texts, as they make a shuffle smaller.

    With several passes subjects and objects are each looked up in as many parts by the hash of the key and stored;
    ``owned`` triples, a stored table that nothing else reads, go after the first of these.

    ``popular`` rows, of which there are at most FIRST_OTHER + MOST_POPULAR, are broadcast, and what
    they answer has no part in a shuffle by term: its key is replaced by one of many that no term has.
    Predicates, which are few and skewed, are broadcast too if they are few indeed.
    """
    near = written(popular.select(key, value).distinct(), "popular")
    rest = dictionary.join(F.broadcast(near.select(key)), key, "left_anti")
    spread = F.pmod(F.xxhash64(*SPO), F.lit(1 << 20))
    nothing = F.concat(F.lit("\0"), spread.cast("string")) if key == "term" else -2 - spread
    out, half = triples, triples if owned else None
    asked = written(triples.select(F.col("p").alias(key)).distinct(), "asked")
    asked = F.broadcast(asked) if fits(asked, BROADCAST_TERMS) else asked
    used = written(rest.join(asked, key, "left_semi").select(key, value), "predicates")
    rest_of = [c for c in triples.columns if c not in SPO]
    for c in ("p", "s", "o") if value == "id" else ("o", "s", "p"):
        out = out.join(F.broadcast(near.select(F.col(key).alias(c), F.col(value).alias(f"_near_{c}"))), c, "left")
        names = (used if c == "p" else rest).select(F.col(key).alias("_key"), F.col(value).alias(f"_far_{c}"))
        if c == "p" and fits(used, BROADCAST_TERMS):
            names = F.broadcast(names)
        out = out.withColumn("_key", F.when(F.col(f"_near_{c}").isNull() & F.col(c).isNotNull(), F.col(c)).otherwise(nothing))
        found = F.coalesce(f"_near_{c}", f"_far_{c}").alias(c)
        kept = [*[found if x == c else F.col(x) for x in SPO], *rest_of]
        if c == "p" or passes == 1:
            out = out.join(names, "_key", "left").select(*kept)
            continue
        # both sides are cut by the key, so a pass shuffles its own part of each
        mine = [in_pass(k, passes, F.col("_key")) for k in range(passes)]
        out = written_parts([out.filter(m).join(names.filter(m), "_key", "left").select(*kept) for m in mine], "looked-up")
        if half is not None:
            removed(half)
        half = out
    return out


def encode(triples: DataFrame, dictionary: DataFrame, passes: int = 1, owned: bool = False) -> DataFrame:
    """Text triples as ids; a term that the dictionary lacks, and null, become null. Standard and popular terms don't shuffle."""
    return _joined(triples, dictionary, "term", "id", dictionary.filter(F.col("id") < FIRST_OTHER), passes, owned)


def decode(triples: DataFrame, dictionary: DataFrame, threshold: int | None = None, fraction: float = 1.0, passes: int = 1) -> DataFrame:
    """Triples of ids as text; an unknown id and null become null.

    Standard and popular ids don't shuffle; with ``threshold`` neither do ids that occur as often in a
    sample of ``fraction``.
    """
    popular = dictionary.filter(F.col("id") < FIRST_OTHER)
    if threshold is not None:
        popular = popular.unionByName(texts_of_ids(dictionary, popular_ids(triples, threshold, fraction)))
    return _joined(triples, dictionary, "id", "term", popular, passes)


def lookup(dictionary: DataFrame, requests: DataFrame) -> DataFrame:
    """(term, pos, query): a pattern query for each requested term that the dictionary has."""
    at = reduce(
        lambda made, k: made.when(F.upper("pos") == "SPO"[k], F.concat_ws(" ", *[F.col("id").cast("string") if j == k else F.lit("-1") for j in range(3)])),
        (1, 2),
        F.when(F.upper("pos") == "S", F.concat_ws(" ", F.col("id").cast("string"), F.lit("-1"), F.lit("-1"))),
    )
    return dictionary.join(requests, "term").select("term", "pos", at.alias("query"))


def ids_of(dictionary: DataFrame, terms: list[str]) -> dict[str, int]:
    """Ids of the given terms (a rule set's constants)."""
    return {r["term"]: r["id"] for r in dictionary.filter(F.col("term").isin(terms)).collect()}


def compress(spark: SparkSession, triples: DataFrame, existing: DataFrame | None = None, threshold: int | None = None, fraction: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(encoded distinct triples, dictionary).

    Large graphs go in passes, each over the whole input but shuffling only its own subjects or terms;
    what a step stored goes when the next one is stored.
    """
    triples = triples.select(*SPO)
    passes = passes_for(triples)
    parts = [triples] if passes == 1 else [triples.filter(in_pass(k, passes, F.col("s"))) for k in range(passes)]
    # neighbours share subjects or their beginnings, so files of sorted rows are small
    text = written_parts([x.distinct().sortWithinPartitions("s") if passes > 1 else x.distinct() for x in parts], "text")
    ranges: list[DataFrame] = []
    dictionary = written(build(text, existing, threshold, fraction, ranges, passes), "dictionary")
    for x in ranges:
        removed(x)
    return encode(text, dictionary, passes, owned=passes > 1), dictionary

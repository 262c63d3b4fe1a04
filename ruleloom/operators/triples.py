"""Operators on tables of triples: patterns, duplicates, counts, permutations, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SPO, Atom, Var

#: The six permutations by id.
PERMUTATIONS = ["spo", "sop", "pos", "pso", "ops", "osp"]


# ---- filters ----------------------------------------------------------------------------------


def pattern_scan(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples with the given values; None matches any. Equalities reach the file scan."""
    return reduce(lambda d, x: d.filter(F.col(x[0]) == F.lit(x[1])), [(c, v) for c, v in zip(SPO, (s, p, o), strict=True) if v is not None], triples)


def matches(atom: Atom, names: list[str] | None = None) -> Column:
    """The condition of an atom: its constants, and equality where a variable repeats."""
    columns = names or SPO
    found: list[Column] = []
    first: dict[str, str] = {}
    for column, term in zip(columns, atom.terms, strict=True):
        if not isinstance(term, Var):
            found.append(F.col(column) == F.lit(term))
        elif term.name in first:
            found.append(F.col(column) == F.col(first[term.name]))
        else:
            first[term.name] = column
    return reduce(lambda a, b: a & b, found, F.lit(True)) if found else F.lit(True)


def bindings(triples: DataFrame, atom: Atom) -> DataFrame:
    """One column for each variable of the atom, one row for each matching triple."""
    place = {t.name: c for c, t in reversed(list(zip(SPO, atom.terms, strict=True))) if isinstance(t, Var)}
    return triples.filter(matches(atom)).select(*[F.col(place[v]).alias(v) for v in atom.variables])


def answer_patterns(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, s, p, o) for a table of patterns, -1 for any.

    A pattern is its own key: each triple, read once, is looked up with its values blanked as in each
    shape that occurs among the queries (at most eight), in one equi-join.
    """
    any_ = F.lit("-1").cast(queries.schema["s"].dataType)
    bits = sum((F.when(F.col(c) == any_, 0).otherwise(1 << k) for k, c in enumerate(SPO)), F.lit(0))
    shapes = sorted(r[0] for r in queries.select(bits.alias("b")).distinct().collect())
    keys = [F.struct(*[(F.col(c) if b >> k & 1 else any_).alias(f"_{c}") for k, c in enumerate(SPO)]) for b in shapes]
    if not keys:
        return triples.limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), *SPO)
    asked = queries.select("qid", *[F.col(c).alias(f"_{c}") for c in SPO])
    looked = triples.select(*SPO, F.explode(F.array(*keys)).alias("_k")).select(*SPO, "_k.*")
    return looked.join(asked, [f"_{c}" for c in SPO]).select("qid", *SPO)


def filter_step(triples: DataFrame, least: int) -> DataFrame:
    return triples.filter(F.col("step") >= least)


def schema_filter(triples: DataFrame, predicates: list) -> DataFrame:
    return triples.filter(F.col("p").isin(predicates))


def schema_filter_rules(triples: DataFrame, atoms: list[Atom]) -> DataFrame:
    """Triples that match the constants of any of the atoms, once."""
    if not atoms:
        return triples.limit(0)
    return triples.filter(reduce(lambda a, b: a | b, [matches(a) for a in atoms]))


def replace_steps(triples: DataFrame, former: DataFrame) -> DataFrame:
    """Steps as they were in ``former`` (s, p, o, step) for triples that it holds."""
    old = former.groupBy(*SPO).agg(F.min("step").alias("_old"))
    return triples.join(old, SPO, "left").withColumn("step", F.coalesce("_old", "step")).drop("_old")


# ---- duplicates and counts --------------------------------------------------------------------


def distinct_text(triples: DataFrame) -> DataFrame:
    return triples.select(*SPO).distinct()


def remove_duplicates(triples: DataFrame) -> DataFrame:
    """Each triple once, with its lowest step."""
    return triples.groupBy(*SPO).agg(F.min("step").alias("step"))


def sum_counts(triples: DataFrame) -> DataFrame:
    """Each triple once: lowest step, sum of counts."""
    return triples.groupBy(*SPO).agg(F.min("step").alias("step"), F.sum("cnt").alias("cnt"))


def derivation_counts(rows: DataFrame, least: int) -> DataFrame:
    """(s, p, o, step, cnt): lowest step, and how many rows have a step from ``least``; others go."""
    return (
        rows.groupBy(*SPO)
        .agg(F.min("step").alias("step"), F.count_if(F.col("step") >= least).alias("cnt"))
        .filter("cnt > 0")
    )


def sampled(triples: DataFrame, fraction: float) -> DataFrame:
    """The triples whose MD5 lies in the lowest ``fraction`` of all values: the same ones wherever they are read."""
    if fraction >= 1:
        return triples
    return triples.filter(F.substring(F.md5(F.concat_ws(" ", *SPO)), 1, 8) < F.lit(f"{int(fraction * (1 << 32)):08x}"))


def count_terms(triples: DataFrame, fraction: float = 1.0) -> DataFrame:
    """(term, n) over all three positions, of all triples or a sample."""
    return sampled(triples, fraction).select(F.explode(F.array(*SPO)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def max_step(rows: DataFrame, column: str) -> DataFrame:
    """The highest step of each value that can take part in a join."""
    return rows.groupBy(column).agg(F.max("step").alias("step"))


# ---- permutations -----------------------------------------------------------------------------


def permute(triples: DataFrame) -> DataFrame:
    """(perm, a, b, c, step, cnt): six rows for each triple; cnt is 1 if there is none."""
    have = set(triples.columns)
    extra = [F.col("step") if "step" in have else F.lit(0).alias("step"), F.col("cnt") if "cnt" in have else F.lit(1).cast("bigint").alias("cnt")]
    rows = F.explode(
        F.array(*[F.struct(F.lit(k).alias("perm"), *[F.col(x).alias(y) for x, y in zip(name, "abc", strict=True)]) for k, name in enumerate(PERMUTATIONS)])
    )
    return triples.select(rows.alias("_t"), *extra).select("_t.*", "step", "cnt")


def schema_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two atoms' bindings with steps: a result's step is the later of both."""
    later = F.greatest(F.col("step"), F.col("_step")).alias("step")
    both = left.join(right.withColumnRenamed("step", "_step"), on)
    return both.select(*[c for c in both.columns if c not in ("step", "_step")], later)


def acceptable(triples: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """Triples whose value in ``column`` occurs in ``values``."""
    return triples.join(values.select(F.col(key).alias(column)).distinct(), column, "left_semi")


# ---- set operations ---------------------------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*SPO).unionByName(b.select(*SPO)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*SPO), SPO, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*SPO), SPO, "left_semi")


def multiset_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, p, o, cnt): counts of both added up."""
    both = a.select(*SPO, "cnt").unionByName(b.select(*SPO, "cnt"))
    return both.groupBy(*SPO).agg(F.sum("cnt").alias("cnt"))


# ---- changes to a stored table ----------------------------------------------------------------


def insert_absent(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the rows whose triple it lacks; of repeated ones the lowest step."""
    own = [c for c in table.columns if c not in SPO]
    fresh = rows.join(table.select(*SPO), SPO, "left_anti").groupBy(*SPO).agg(*[F.min(c).alias(c) for c in own])
    return table.unionByName(fresh.select(*table.columns))


def upsert_counts(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, p, o, step, cnt): counts of both added up, with the lowest step."""
    return sum_counts(table.select(*SPO, "step", "cnt").unionByName(rows.select(*SPO, "step", "cnt")))


def decrease_or_remove(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table less the rows' counts (s, p, o, cnt); triples that fall to zero or below go."""
    less = rows.groupBy(*SPO).agg(F.sum("cnt").alias("_less"))
    left = table.join(less, SPO, "left").withColumn("cnt", F.col("cnt") - F.coalesce("_less", F.lit(0)))
    return left.filter("cnt > 0").select(*table.columns)


def remove_derived(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table without the rows' triples, except those of step 0."""
    gone = rows.select(*SPO).distinct().withColumn("_gone", F.lit(True))
    return table.join(gone, SPO, "left").filter("step = 0 or _gone is null").select(*table.columns)


def sort_distinct(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lines in a global order (ranges over partitions, then sorted within each)."""
    return lines.select(column).distinct().orderBy(column)


def dump(spark: SparkSession, triples: DataFrame, path: str | None = None) -> DataFrame:
    """(line): triples of ids with short names for standard terms; written if ``path`` is given."""
    from ..functions.terms import standard_terms

    local = F.regexp_extract("term", "#([A-Za-z]+)>?$", 1)
    names = standard_terms(spark).select("id", local.alias("name"))
    lines = triples
    for c in SPO:
        lines = lines.join(F.broadcast(names.select(F.col("id").alias(c), F.col("name").alias(f"_{c}"))), c, "left")
    lines = lines.select(F.concat_ws(" ", *[F.coalesce(f"_{c}", F.col(c).cast("string")) for c in SPO], F.col("step").cast("string")).alias("line"))
    if path:
        lines.write.mode("append").text(path)
    return lines

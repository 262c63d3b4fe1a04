"""Materialisation: the semi-naive fixpoint, with or without exact derivation counts.

Stored tables are only ever added to: the knowledge base of a round is the union of the tables of
all rounds, so no round rewrites what was derived before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import DOMAIN, RANGE, SCHEMA_PREDICATES, SUBCLASS, SUBPROPERTY, TYPE
from ..model import SPO, RuleSet
from ..sources.lineage import fits, written
from .compiler import BROADCAST_ROWS, Source, apply_once, consequences

ROUNDS = 500
#: Rows of a delta up to which it is broadcast.
SMALL_DELTA = 100_000


def explicit(triples: DataFrame) -> DataFrame:
    """Distinct input triples as stored rows of step 0."""
    return triples.select(*SPO).distinct().withColumns(
        {"step": F.lit(0), "cnt": F.lit(1).cast("bigint"), "is_explicit": F.lit(True)}
    )


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def unseen(rows: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The rows (s, p, o, distinct, a stored table of ``count``) that ``known`` lacks.

    Few rows are sent to where the known triples are, which stay in place. Many are compared with the
    known triples of their own predicates alone.
    """
    if fits(rows, SMALL_DELTA, count):
        held = known.select(*SPO).join(F.broadcast(rows.select(*SPO)), SPO, "left_semi")
        return rows.join(held, SPO, "left_anti")
    same = known.select(*SPO).join(rows.select("p").distinct(), "p", "left_semi")
    return rows.join(same, SPO, "left_anti")


class Fixpoint:
    """Rounds of consequences from a delta over a knowledge base.

    ``known``: tables of (s, p, o) that are disjoint; ``found``: tables of (s, p, o, n, step), the
    instantiations of each round, if they are counted. ``rounds``, ``fresh`` and ``repeated`` count
    the rounds, the triples that were new, and those of a round that were known before. More than
    ROUNDS rounds are an error; nothing is cut off.
    """

    def __init__(self, rules: RuleSet, known: list[DataFrame], counting: bool = False):
        self.rules, self.known, self.counting = rules, known, counting
        self.found: list[DataFrame] = []
        self.rounds = self.fresh = self.repeated = 0

    def run(self, delta: DataFrame, step: int = 1) -> list[DataFrame]:
        """The new triples of each round (s, p, o, step); delta must be a stored table disjoint from ``known``."""
        new, schema, schema_rows = [], [], 0
        if self.known:
            first = Source(union_all(self.known), self.rules)
            schema, schema_rows = [first.schema] if first.schema is not None else [], first.schema_rows
        size = delta.count()
        while True:
            if self.rounds >= ROUNDS:
                raise RuntimeError(f"no fixpoint after {ROUNDS} rounds")
            self.rounds += 1
            own = Source(delta, self.rules, small=bool(self.known) and fits(delta, SMALL_DELTA, size))
            if self.known:
                before = Source(union_all(self.known), self.rules, union_all(schema) if schema else None, schema_rows)
            schema += [own.schema] if own.schema is not None else []
            schema_rows += own.schema_rows
            if self.known:
                every = Source(
                    union_all([*self.known, delta.select(*SPO)]), self.rules, union_all(schema) if schema else None, schema_rows
                )
                rows = consequences(self.rules, every, own, before)
            else:
                rows = apply_once(self.rules, own)
            self.known.append(delta.select(*SPO))
            if rows is None:
                return new
            if self.counting:
                rows = written(rows.groupBy(*SPO).agg(F.count("*").alias("n")), "counts")
                self.found.append(rows.withColumn("step", F.lit(step)))
            made = written(rows.select(*SPO).distinct(), "made")
            many = made.count()
            delta = written(unseen(made, union_all(self.known), many).withColumn("step", F.lit(step)), "delta")
            size = delta.count()
            self.fresh, self.repeated = self.fresh + size, self.repeated + many - size
            if not size:
                return new
            new.append(delta)
            step += 1


def closure(triples: DataFrame, rules: RuleSet, counting: bool = False, report: dict | None = None) -> DataFrame:
    """The stored table (s, p, o, step, cnt, is_explicit) of everything that follows.

    ``report`` is filled with the fixpoint's counters.

    step is 0 for input triples, else the round that first derived a triple. cnt is 1 for a stated
    triple plus the number of (rule, body match) pairs that derive it, or 1 if they aren't counted.
    """
    base = written(explicit(triples), "explicit")
    fix = Fixpoint(rules, [], counting)
    new = fix.run(base.select(*SPO, "step")) if rules.rules else []
    if report is not None:
        report |= {"rounds": fix.rounds, "new": fix.fresh, "duplicates": fix.repeated}
    derived = [
        d.select(*SPO, "step").withColumns({"cnt": F.lit(0 if counting else 1).cast("bigint"), "is_explicit": F.lit(False)}) for d in new
    ]
    table = union_all([base, *derived])
    return add_counts(table, fix.found) if counting else table


def add_counts(table: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Counts of instantiations added to a stored table's."""
    if not found:
        return table
    rows = [table] + [
        f.select(*SPO, F.lit(None).cast("int").alias("step"), F.col("n").alias("cnt"), F.lit(None).cast("boolean").alias("is_explicit")) for f in found
    ]
    return union_all(rows).groupBy(*SPO).agg(
        F.min("step").alias("step"), F.sum("cnt").alias("cnt"), F.bool_or("is_explicit").alias("is_explicit")
    )


def derivations_per_rule(triples: DataFrame, rules: RuleSet) -> DataFrame:
    """(rule, n): how many body matches each rule has over the closure."""
    rows = apply_once(rules, written(closure(triples, rules).select(*SPO), "closed"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


# ---- RDFS in one pass -------------------------------------------------------------------------


def rdfs_closure(triples: DataFrame, ids: dict[str, int] | None = None) -> DataFrame:
    """(s, p, o): the RDFS closure in one pass over the instance triples.

    The two hierarchies, domains and ranges are closed first, and give each property the list of what
    a triple of it implies, and each class the list of those above it. The triples are then read
    once, with both lists at hand, and all that each implies is made distinct once. Schema triples that rules
    could derive from instance triples (a property below a schema predicate, or a schema predicate
    with a superproperty, domain or range that matters) need the general fixpoint: the caller checks
    ``one_pass_holds``.
    """
    names = ids or {}
    sub_class, sub_property, domain, range_, type_ = (names.get(t, t) for t in (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, TYPE))
    triples = triples.select(*SPO)
    schema = written(triples.filter(F.col("p").isin([sub_class, sub_property, domain, range_])), "schema")
    of = lambda x: schema.filter(F.col("p") == F.lit(x)).select("s", "o")
    properties, classes = written(reach(of(sub_property)), "properties"), written(reach(of(sub_class)), "classes")
    own = of(domain).unionByName(of(range_)).select("s").unionByName(properties.select("s")).distinct()
    ups = written(own.select("s", F.col("s").alias("q")).unionByName(properties.select("s", F.col("o").alias("q"))).distinct(), "ups")

    def classes_of(stated: DataFrame) -> DataFrame:
        """(s, c): the classes that a property's domain or range gives, those of its superproperties and all above."""
        first = ups.join(stated.select(F.col("s").alias("q"), F.col("o").alias("c")), "q").select("s", "c")
        above = first.join(classes.select(F.col("s").alias("c"), F.col("o").alias("d")), "c").select("s", F.col("d").alias("c"))
        return first.unionByName(above).distinct()

    listed = lambda rows, c, name: rows.groupBy("s").agg(F.collect_set(c).alias(name))
    implied = (
        listed(ups, "q", "supers")
        .join(listed(classes_of(of(domain)), "c", "subject_of"), "s", "left")
        .join(listed(classes_of(of(range_)), "c", "object_of"), "s", "left")
        .withColumnRenamed("s", "p")
    )
    above = written(listed(classes, "o", "classes").withColumnRenamed("s", "_class"), "above")
    marked = triples.withColumn("_class", F.when(F.col("p") == F.lit(type_), F.col("o")))
    known = marked.join(small(written(implied, "implied")), "p", "left")
    if fits(above, BROADCAST_ROWS):
        known = known.join(F.broadcast(above), "_class", "left")
    else:
        # rows that are no types have no part in a shuffle by class
        known = known.filter("_class is not null").join(above, "_class", "left").unionByName(
            known.filter("_class is null").withColumn("classes", F.lit(None).cast(above.schema["classes"].dataType))
        )
    kind = triples.schema["p"].dataType.simpleString()
    empty = f"cast(array() as array<{kind}>)"
    is_a = "cast({} as " + kind + ")"
    type_sql = is_a.format(repr(type_) if isinstance(type_, str) else type_)
    parts = [
        "array(named_struct('s', s, 'p', p, 'o', o))",
        f"transform(coalesce(supers, {empty}), q -> named_struct('s', s, 'p', q, 'o', o))",
        f"transform(coalesce(subject_of, {empty}), c -> named_struct('s', s, 'p', {type_sql}, 'o', c))",
        f"transform(coalesce(object_of, {empty}), c -> named_struct('s', o, 'p', {type_sql}, 'o', c))",
        f"transform(coalesce(classes, {empty}), c -> named_struct('s', s, 'p', p, 'o', c))",
    ]
    every = known.select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias("t")).select("t.*")
    as_triples = lambda d, p: d.select("s", F.lit(p).alias("p"), "o")
    return union_all([every, as_triples(properties, sub_property), as_triples(classes, sub_class)]).distinct()


def one_pass_holds(triples: DataFrame, ids: dict[str, int] | None = None) -> bool:
    """Whether no schema predicate and not rdf:type takes part in the property hierarchy or has a domain or range."""
    names = ids or {}
    special = [names.get(t, t) for t in (*SCHEMA_PREDICATES, TYPE)]
    about = [names.get(t, t) for t in (SUBPROPERTY, DOMAIN, RANGE)]
    bad = triples.filter(F.col("p").isin(about) & (F.col("s").isin(special) | ((F.col("p") == F.lit(about[0])) & F.col("o").isin(special))))
    return bad.isEmpty()


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The stored table, to be broadcast if its size allows."""
    return F.broadcast(table) if fits(table, most) else table


def reach(edges: DataFrame) -> DataFrame:
    """(s, o): the transitive closure of edges, path lengths doubling each round (an error after ROUNDS)."""
    paths = written(edges.select("s", "o").distinct(), "paths")
    delta = paths
    for _ in range(ROUNDS):
        left = delta.select("s", F.col("o").alias("m")).join(paths.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        right = paths.select("s", F.col("o").alias("m")).join(delta.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        delta = written(left.unionByName(right).distinct().join(paths, ["s", "o"], "left_anti"), "paths")
        if delta.isEmpty():
            return paths
        paths = paths.unionByName(delta)
    raise RuntimeError(f"no fixpoint after {ROUNDS} rounds")

"""Rules as DataFrame plans.

A body becomes a natural join of its atoms' bindings, its head a projection. For semi-naive
evaluation the body is evaluated once for each atom that may match new triples: atoms before it see
one table, atoms after it another, so every instantiation is produced exactly once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPO, Atom, Rule, RuleSet, Var
from ..operators.triples import bindings, matches, schema_filter_rules
from ..sources.lineage import fits, written

#: Rows of schema triples up to which an atom's side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


class Source:
    """A table of triples, with its schema part (the rows that marked atoms can match) set apart.

    The schema part is one small scan; it is broadcast only if its counted size allows.
    """

    def __init__(
        self, triples: DataFrame, rules: RuleSet, schema: DataFrame | None = None, schema_rows: int | None = None, small: bool = False
    ):
        self.triples = triples
        atoms = rules.schema_atoms()
        if schema is None and atoms:
            schema = written(schema_filter_rules(triples.select(*SPO), atoms), "schema")
        self.schema = schema
        #: Counted from the files' footers unless the caller knows.
        self.schema_rows = schema_rows if schema_rows is not None else schema.count() if schema is not None else 0
        self.few = schema is not None and fits(schema, BROADCAST_ROWS, self.schema_rows)
        #: All of it may be broadcast (a delta of few rows).
        self.small = small

    def rows(self, atom: Atom) -> DataFrame:
        if atom.schema and self.schema is not None:
            rows = bindings(self.schema, atom)
            return F.broadcast(rows) if self.few else rows
        rows = bindings(self.triples, atom)
        return F.broadcast(rows) if self.small else rows


def order(body: tuple[Atom, ...], first: int) -> list[int]:
    """Atoms from ``first`` on, each sharing a variable with those before; marked atoms as early as they can."""
    left = [k for k in range(len(body)) if k != first]
    known, out = set(body[first].variables), [first]
    while left:
        linked = [k for k in left if known & set(body[k].variables) or not body[k].variables]
        if not linked:
            raise ValueError("the atoms of a rule's body must be connected by variables")
        k = min(linked, key=lambda k: (not body[k].schema, k))
        out.append(k)
        left.remove(k)
        known |= set(body[k].variables)
    return out


def instantiations(rule: Rule, sources: list[Source], first: int = 0) -> DataFrame:
    """(s, p, o) of the head, a row for each way to match the body, atom k in sources[k]."""
    body = rule.body
    joined, seen = None, set()
    for k in order(body, first):
        atom = body[k]
        if not atom.variables:
            # a ground atom either holds or not
            if sources[k].triples.filter(matches(atom)).isEmpty():
                return _heads(rule, _nothing(rule, sources[0].triples))
            continue
        rows = sources[k].rows(atom)
        shared = [v for v in atom.variables if v in seen]
        joined = rows if joined is None else joined.join(rows, shared)
        seen |= set(atom.variables)
    if joined is None:
        joined = sources[0].triples.sparkSession.range(1)
    return _heads(rule, joined)


def _nothing(rule: Rule, like: DataFrame) -> DataFrame:
    kind = like.schema["s"].dataType
    names = rule.head.variables or ["_none"]
    return like.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(v) for v in names])


def _heads(rule: Rule, rows: DataFrame) -> DataFrame:
    return rows.select(
        *[(F.col(t.name) if isinstance(t, Var) else F.lit(t)).alias(c) for c, t in zip(SPO, rule.head.terms, strict=True)]
    )


def touched(rules: RuleSet, delta: DataFrame) -> list[tuple[Rule, int]]:
    """(rule, atom) whose atom can match something in delta, by the predicates that occur in it.

    Only predicates that rules name are looked for, so the answer's size is that of the rule set.
    """
    named = list({a.p for r in rules.rules for a in r.body if not isinstance(a.p, Var)})
    present = {r[0] for r in delta.filter(F.col("p").isin(named)).select("p").distinct().collect()} if named else set()
    return [(r, k) for r in rules.rules for k, a in enumerate(r.body) if isinstance(a.p, Var) or a.p in present]


def consequences(rules: RuleSet, before: Source, delta: Source, after: Source) -> DataFrame | None:
    """(rule, s, p, o): every instantiation that uses at least one triple of delta, once.

    For each atom in turn: atoms to its left from ``before``, itself from ``delta``, atoms to its
    right from ``after``. None if no rule can fire.
    """
    found = [
        instantiations(r, [before] * k + [delta] + [after] * (len(r.body) - k - 1), k).select(F.lit(r.number).alias("rule"), *SPO)
        for r, k in touched(rules, delta.triples)
    ]
    return reduce(DataFrame.unionByName, found) if found else None


def rederived(rules: RuleSet, source: Source, wanted: DataFrame, few: bool) -> DataFrame | None:
    """(s, p, o): those of the wanted triples that one step of the rules derives from the table.

    A rule's head is joined with the wanted triples first, so its body is only looked up for them.
    """
    found = []
    for r in rules.rules:
        if not r.head.variables and wanted.filter(matches(r.head)).isEmpty():
            continue
        head = bindings(wanted, r.head).distinct()
        rows, seen = F.broadcast(head) if few else head, set(r.head.variables)
        left = list(r.body)
        while left:
            # an atom that shares no variable with what is joined so far waits
            a = min(left, key=lambda a: (bool(a.variables) and not seen & set(a.variables), not a.schema))
            left.remove(a)
            if not a.variables:
                if source.triples.filter(matches(a)).isEmpty():
                    rows = rows.limit(0)
            elif not seen:
                rows = source.rows(a)
            elif shared := [v for v in a.variables if v in seen]:
                rows = rows.join(source.rows(a), shared)
            else:
                raise ValueError("the atoms of a rule's body must be connected by variables")
            seen |= set(a.variables)
        if not r.head.variables:
            rows = rows.limit(1)
        found.append(_heads(r, rows).distinct())
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def apply_once(rules: RuleSet, triples: DataFrame | Source) -> DataFrame | None:
    """(rule, s, p, o): every instantiation of every rule over the table; None without rules."""
    if not rules.rules:
        return None
    source = triples if isinstance(triples, Source) else Source(triples, rules)
    found = []
    for r in rules.rules:
        # the join starts at an atom that is not broadcast
        first = next((k for k, a in enumerate(r.body) if not a.schema), 0)
        found.append(instantiations(r, [source] * len(r.body), first).select(F.lit(r.number).alias("rule"), *SPO))
    return reduce(DataFrame.unionByName, found)

"""Maintenance of a materialised table under additions and removals.

Every operation works out a ``Change``: the rows to put and the triples that go, which a store appends
to what it has. Nothing else of the table is written again. Whether a fact was stated is kept apart
from the round that derived it, so a stated fact is never removed as a consequence of others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPO, RuleSet
from ..sources.lineage import fits, written
from .closure import ROUNDS, SMALL_DELTA, Fixpoint, union_all
from .compiler import Source, consequences, rederived

COLUMNS = [*SPO, "step", "cnt", "is_explicit"]


@dataclass
class Change:
    """``rows`` (stored rows) take the place of, or come beside, what is there; ``gone`` (s, p, o) leaves first.

    Every row whose triple is in the table has its triple in ``gone`` too. ``report`` counts what happened.
    """

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    report: dict = field(default_factory=dict)


def few(rows: DataFrame) -> DataFrame:
    """The stored table, to be broadcast if its size allows."""
    return F.broadcast(rows) if fits(rows, SMALL_DELTA) else rows


def applied(table: DataFrame, change: Change) -> DataFrame:
    out = table.select(*COLUMNS)
    if change.gone is not None:
        out = out.join(few(change.gone), SPO, "left_anti")
    return out if change.rows is None else out.unionByName(change.rows.select(*COLUMNS))


def last_step(table: DataFrame) -> int:
    return table.agg(F.max("step")).first()[0] or 0


def held(table: DataFrame, keys: DataFrame, label: str) -> DataFrame:
    """The table's rows whose triple is among the keys (a stored table); few keys travel to the table."""
    return written(table.select(*COLUMNS).join(few(keys).select(*SPO), SPO, "left_semi"), label)


# ---- additions --------------------------------------------------------------------------------


def addition(table: DataFrame, facts: DataFrame, rules: RuleSet, counting: bool = False, step: int | None = None) -> Change:
    """What stating more facts changes.

    A fact that was derived becomes stated as well (its count grows by one); one that was stated
    changes nothing. The rest is the first delta of a fixpoint over the table and all deltas.
    ``step`` is the table's last step if the caller knows it.
    """
    facts = written(facts.select(*SPO).distinct(), "facts")
    known = held(table, facts, "known")
    flips = known.filter("not is_explicit").withColumns({"cnt": F.col("cnt") + F.lit(int(counting)), "is_explicit": F.lit(True)})
    fresh = written(facts.join(known.select(*SPO), SPO, "left_anti").withColumn("step", F.lit(0)), "fresh")
    some = not fresh.isEmpty()
    fix = Fixpoint(rules, [table.select(*SPO)], counting)
    first = (last_step(table) if step is None else step) + 1
    new = fix.run(fresh, first) if rules.rules and some else []
    rows = [flips, fresh.withColumns({"cnt": F.lit(1).cast("bigint"), "is_explicit": F.lit(True)})]
    rows += [d.withColumns({"cnt": F.lit(0 if counting else 1).cast("bigint"), "is_explicit": F.lit(False)}) for d in new]
    gone = flips
    if counting and fix.found:
        more = written(union_all(fix.found).groupBy(*SPO).agg(F.sum("n").alias("n")), "more")
        touched = held(table, more, "touched")
        gone = flips.select(*SPO).unionByName(touched.select(*SPO)).distinct()
        rows.append(touched.join(flips.select(*SPO), SPO, "left_anti"))
        rows.append(more.select(*SPO, F.lit(None).cast("int").alias("step"), F.col("n").alias("cnt"), F.lit(None).cast("boolean").alias("is_explicit")))
        all_rows = union_all([r.select(*COLUMNS) for r in rows]).groupBy(*SPO).agg(
            F.min("step").alias("step"), F.sum("cnt").alias("cnt"), F.bool_or("is_explicit").alias("is_explicit")
        )
    else:
        all_rows = union_all([r.select(*COLUMNS) for r in rows])
    put, gone = written(all_rows, "put"), written(gone.select(*SPO), "replaced")
    return Change(put, gone, {"rounds": fix.rounds, "new": fix.fresh + fresh.count(), "duplicates": fix.repeated, "restated": gone.count()})


def add(table: DataFrame, facts: DataFrame, rules: RuleSet, counting: bool = False) -> DataFrame:
    """The table after ``addition``."""
    return applied(table, addition(table, facts, rules, counting))


# ---- removal by deletion and re-derivation ----------------------------------------------------


def overdeleted(table: DataFrame, first: DataFrame, every: Source, rules: RuleSet) -> tuple[DataFrame, int]:
    """(s, p, o): ``first`` and all that has a derivation from it over the table; and the rounds taken."""
    gone, delta = [first.select(*SPO)], first.select(*SPO)
    free = table.filter("not is_explicit")
    for done in range(ROUNDS):
        own = Source(delta, rules, small=fits(delta, SMALL_DELTA))
        rows = consequences(rules, every, own, every)
        if rows is None:
            return written(union_all(gone), "gone"), done
        # stated facts stay, whatever else derived them
        made = written(rows.select(*SPO).distinct().join(union_all(gone), SPO, "left_anti"), "made")
        delta = held(free, made, "overdeleted").select(*SPO)
        if delta.isEmpty():
            return written(union_all(gone), "gone"), done + 1
        gone.append(delta)
    raise RuntimeError(f"no fixpoint after {ROUNDS} rounds")


def removal(table: DataFrame, facts: DataFrame, rules: RuleSet, counting: bool = False) -> Change:
    """What taking back stated facts changes, by deletion and re-derivation.

    Everything with a derivation from the facts goes; what one step of the rules derives from the
    rest comes back, looked for only among what went, with all that follows. Facts that were not
    stated change nothing. Steps of what stays or comes back are kept. With ``counting`` the counts
    are brought up to date, by the instantiations that are lost.
    """
    first = held(table.filter("is_explicit"), written(facts.select(*SPO).distinct(), "facts"), "first")
    if first.isEmpty():
        return Change(report={"removed": 0, "rounds": 0})
    every = Source(table.select(*SPO), rules)
    gone, rounds = overdeleted(table, first, every, rules)
    less = few(gone)
    kept = Source(table.select(*SPO).join(less, SPO, "left_anti"), rules, _without(every.schema, less), every.schema_rows)
    rows = rederived(rules, kept, gone, fits(gone, SMALL_DELTA))
    back = [] if rows is None else [written(rows.join(gone, SPO, "left_semi").withColumn("step", F.lit(0)), "back")]
    if back and not back[0].isEmpty():
        fix = Fixpoint(rules, [kept.triples])
        back += fix.run(back[0])
        rounds += fix.rounds
    returned = written(union_all([b.select(*SPO) for b in back]), "returned") if back else None
    dead = gone if returned is None else written(gone.join(returned, SPO, "left_anti"), "dead")
    lost = [first.select(*SPO, F.lit(1).cast("bigint").alias("n"))] if counting else []
    if counting:
        small = fits(dead, SMALL_DELTA)
        over = few(dead)
        left = Source(table.select(*SPO).join(over, SPO, "left_anti"), rules, _without(every.schema, over), every.schema_rows)
        used = consequences(rules, left, Source(dead, rules, small=small), every)
        lost += [] if used is None else [used.groupBy(*SPO).agg(F.count("*").alias("n"))]
    return _change(table, first, dead, lost, rounds)


def _without(schema: DataFrame | None, gone: DataFrame) -> DataFrame | None:
    return None if schema is None else schema.join(gone, SPO, "left_anti")


def _change(table: DataFrame, first: DataFrame, dead: DataFrame, lost: list[DataFrame], rounds: int) -> Change:
    """The dead triples go; what stays of ``first`` is stated no more; ``lost`` (s, p, o, n) comes off the counts."""
    keys = [first.select(*SPO).withColumns({"n": F.lit(0).cast("bigint"), "_unstated": F.lit(True)})]
    keys += [x.select(*SPO, "n").withColumn("_unstated", F.lit(False)) for x in lost]
    touched = written(union_all(keys).groupBy(*SPO).agg(F.sum("n").alias("n"), F.bool_or("_unstated").alias("_unstated")), "lost")
    touched = written(touched.join(dead, SPO, "left_anti"), "touched")
    rows = written(
        table.join(few(touched), SPO).select(
            *SPO, "step", (F.col("cnt") - F.col("n")).alias("cnt"), (F.col("is_explicit") & ~F.col("_unstated")).alias("is_explicit")
        ),
        "put",
    )
    gone = written(dead.select(*SPO).unionByName(rows.select(*SPO)), "replaced")
    return Change(rows, gone, {"removed": dead.count(), "rounds": rounds})


def remove(table: DataFrame, facts: DataFrame, rules: RuleSet, counting: bool = False) -> DataFrame:
    """The table after ``removal``."""
    return applied(table, removal(table, facts, rules, counting))


# ---- removal by counts ------------------------------------------------------------------------


def removal_counting(table: DataFrame, facts: DataFrame, rules: RuleSet) -> Change:
    """What taking back stated facts changes, by counts alone; the table must have exact counts.

    Each round takes the instantiations that used a triple whose count fell to zero in the round
    before, each once, and looks at the triples that they derived. Triples that support each other in a cycle keep
    counts above zero and stay, which ``removal`` would take back.
    """
    first = held(table.filter("is_explicit"), written(facts.select(*SPO).distinct(), "facts"), "first")
    if first.isEmpty():
        return Change(report={"removed": 0, "rounds": 0})
    every = Source(table.select(*SPO), rules)
    lost = [first.select(*SPO, F.lit(1).cast("bigint").alias("n"))]
    dead: list[DataFrame] = []
    before = every
    for done in range(ROUNDS):
        # only what lost something in the last round can have died in it
        total = union_all(lost).join(few(written(lost[-1].select(*SPO), "last")), SPO, "left_semi").groupBy(*SPO).agg(F.sum("n").alias("n"))
        total = written(total if not dead else total.join(union_all(dead), SPO, "left_anti"), "total")
        delta = written(table.join(few(total), SPO).filter("cnt <= n").select(*SPO), "dead")
        if delta.isEmpty():
            break
        dead.append(delta)
        over = few(written(union_all(dead), "over"))
        after = Source(table.select(*SPO).join(over, SPO, "left_anti"), rules, _without(every.schema, over), every.schema_rows)
        rows = consequences(rules, after, Source(delta, rules, small=fits(delta, SMALL_DELTA)), before)
        before = after
        if rows is None:
            break
        lost.append(written(rows.groupBy(*SPO).agg(F.count("*").alias("n")), "lost"))
    else:
        raise RuntimeError(f"no fixpoint after {ROUNDS} rounds")
    gone = written(union_all(dead), "gone") if dead else first.select(*SPO).limit(0)
    return _change(table, first, gone, lost, done + 1)


def remove_counting(table: DataFrame, facts: DataFrame, rules: RuleSet) -> DataFrame:
    """The table after ``removal_counting``."""
    return applied(table, removal_counting(table, facts, rules))

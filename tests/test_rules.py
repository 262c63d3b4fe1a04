from __future__ import annotations

import random

import pytest

from ruleloom.functions.terms import DOMAIN, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from ruleloom.model import SPO, TEXT_TRIPLE, RuleSet
from ruleloom.plans import closure as c
from ruleloom.plans import incremental as inc
from ruleloom.plans.compiler import apply_once
from ruleloom.sources import rulefile
from ruleloom.sources.lineage import written

from . import naive

GRAPHS = {
    "chain": [("A", SUBCLASS, "B"), ("B", SUBCLASS, "C"), ("C", SUBCLASS, "D"), ("x", TYPE, "A")],
    "diamond": [("A", SUBCLASS, "B"), ("A", SUBCLASS, "C"), ("B", SUBCLASS, "D"), ("C", SUBCLASS, "D"), ("x", TYPE, "A")],
    "cycle": [("A", SUBCLASS, "B"), ("B", SUBCLASS, "C"), ("C", SUBCLASS, "A"), ("x", TYPE, "A")],
    "props": [("p1", SUBPROPERTY, "p2"), ("p2", SUBPROPERTY, "p3"), ("p3", DOMAIN, "C"), ("p3", RANGE, "D"), ("x", "p1", "y")],
    "meta": [("mySub", SUBPROPERTY, SUBCLASS), ("A", "mySub", "B"), ("x", TYPE, "A")],
    "explicit_and_derived": [("A", SUBCLASS, "B"), ("x", TYPE, "A"), ("x", TYPE, "B")],
    "empty": [],
}


def random_graph(seed: int) -> list[tuple[str, str, str]]:
    r = random.Random(seed)
    nodes, props = "ABCDE", ["p", "q", TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE]
    return list({(r.choice([*nodes, "p", "q"]), r.choice(props), r.choice([*nodes, "p", "q"])) for _ in range(9)})


def frame(spark, triples):
    return spark.createDataFrame(sorted(triples), TEXT_TRIPLE)


def as_set(df):
    return {tuple(r) for r in df.select(*SPO).collect()}


def as_counts(df):
    rows = df.select(*SPO, "cnt").collect()
    out = {tuple(r)[:3]: r["cnt"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_closure_and_counts(spark, name):
    rules = rulefile.rdfs()
    assert as_counts(c.closure(frame(spark, GRAPHS[name]), rules, counting=True)) == naive.counts(rules, GRAPHS[name])
    assert as_set(c.closure(frame(spark, GRAPHS[name]), rules)) == naive.closure(rules, GRAPHS[name])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    graph, rules = random_graph(seed), rulefile.rdfs()
    assert as_counts(c.closure(frame(spark, graph), rules, counting=True)) == naive.counts(rules, graph)


@pytest.mark.parametrize("name", ["props", "diamond", "cycle"])
def test_one_pass(spark, name):
    rows = frame(spark, GRAPHS[name])
    assert c.one_pass_holds(rows)
    assert as_set(c.rdfs_closure(rows)) == naive.closure(rulefile.rdfs(), GRAPHS[name])


def test_one_pass_guard(spark):
    assert not c.one_pass_holds(frame(spark, GRAPHS["meta"]))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("counting", [False, True])
def test_add_equals_closure_of_both(spark, seed, counting):
    rules, graph = rulefile.rdfs(), random_graph(seed + 10)
    first, more = graph[:5], graph[4:]
    table = written(c.closure(frame(spark, first), rules, counting))
    out = inc.add(table, frame(spark, more), rules, counting)
    assert as_set(out) == naive.closure(rules, graph)
    if counting:
        assert as_counts(out) == naive.counts(rules, graph)
    assert {tuple(r)[:3] for r in out.filter("is_explicit").select(*SPO).collect()} == set(graph)


@pytest.mark.parametrize("seed", range(2))
def test_remove_equals_closure_of_rest(spark, seed):
    rules, graph = rulefile.rdfs(), random_graph(seed + 20)
    table = written(c.closure(frame(spark, graph), rules, counting=True))
    gone = graph[:3]
    out = inc.remove(table, frame(spark, gone), rules, counting=True)
    assert as_counts(out) == naive.counts(rules, graph[3:])


def test_remove_a_schema_edge_of_the_diamond(spark):
    rules, graph = rulefile.rdfs(), GRAPHS["diamond"]
    table = written(c.closure(frame(spark, graph), rules, counting=True))
    rest = [t for t in graph if t != ("A", SUBCLASS, "B")]
    gone = frame(spark, [("A", SUBCLASS, "B")])
    assert as_set(inc.remove(table, gone, rules)) == naive.closure(rules, rest)
    assert as_counts(inc.remove_counting(table, gone, rules)) == naive.counts(rules, rest)


def test_counting_keeps_what_a_cycle_supports(spark):
    """Removal by counts is unsound on cycles; deletion and re-derivation is not."""
    rules = rulefile.parse_rules("(?y p ?x) :- (?x p ?y)".replace(" p ", " <p> "))
    graph = [("a", "<p>", "b")]
    table = written(c.closure(frame(spark, graph), rules, counting=True))
    gone = frame(spark, graph)
    assert as_set(inc.remove(table, gone, rules)) == set()
    assert as_set(inc.remove_counting(table, gone, rules)) == {("a", "<p>", "b"), ("b", "<p>", "a")}


def test_remove_absent_and_readd(spark):
    rules, graph = rulefile.rdfs(), GRAPHS["explicit_and_derived"]
    table = written(c.closure(frame(spark, graph), rules, counting=True))
    assert as_counts(inc.remove(table, frame(spark, [("z", TYPE, "Z")]), rules, counting=True)) == as_counts(table)
    less = written(inc.remove(table, frame(spark, [("x", TYPE, "B")]), rules, counting=True))
    assert ("x", TYPE, "B") in as_set(less)
    assert not less.filter(f"s = 'x' and o = 'B'").first()["is_explicit"]
    again = inc.add(less, frame(spark, [("x", TYPE, "B")]), rules, counting=True)
    assert as_counts(again) == as_counts(table)


def test_beyond_two_atoms(spark):
    graph = [("a", "<p>", "b"), ("b", "<q>", "c"), ("c", "<r>", "d"), ("d", "<p>", "d")]
    rules = rulefile.parse_rules("(?a <s> ?d) :- (?a <p> ?b), (?b <q> ?c), (?c <r> ?d)\n(?x <loop> ?x) :- (?x <p> ?x)")
    assert as_set(c.closure(frame(spark, graph), rules)) == naive.closure(rules, graph)


def test_ground_atoms(spark):
    graph = [("a", "<p>", "b"), ("on", "<is>", "true")]
    rules = rulefile.parse_rules("(?x <q> ?y) :- (?x <p> ?y), (<on> <is> <true>)\n(?x <r> ?y) :- (?x <p> ?y), (<off> <is> <true>)")
    swap = {"<on>": "on", "<true>": "true", "<off>": "off", "<is>": "<is>", "<p>": "<p>", "<q>": "<q>", "<r>": "<r>"}
    rules = rules.mapped(swap)
    assert as_set(c.closure(frame(spark, graph), rules)) == {*graph, ("a", "<q>", "b")}


def test_rule_files():
    rules = rulefile.parse_rules("# comment\n\n(?x 0 ?b) :- (?a 5 ?b)*,(?x 0 ?a)\n(?x <p q> ?y) :- (?y rdf:type ?x)\n")
    assert [r.kind for r in rules.rules] == ["mixed", "generic"]
    assert rules.rules[0].body[0].p == 5 and rules.rules[0].body[0].schema
    assert rulefile.rdfs().of_kind("schema")[0].head.p == SUBCLASS
    for bad in ("(?x 0 ?b)", "(?x 0) :- (?x 0 ?b)", "(?x 0 ?z) :- (?x 0 ?b)", "(?x nope:p ?b) :- (?x 0 ?b)", "(?x 0 ?b) :- (?x 0 ?b) junk"):
        with pytest.raises(ValueError):
            rulefile.parse_rules(bad)
    with pytest.raises(ValueError, match="connected"):
        from ruleloom.plans.compiler import order

        order(rulefile.parse_rule("(?x 0 ?y) :- (?x 1 ?a), (?y 2 ?b)", 1).body, 0)


def test_no_rules(spark):
    rows = frame(spark, GRAPHS["chain"])
    assert as_set(c.closure(rows, RuleSet())) == set(GRAPHS["chain"])
    assert apply_once(RuleSet(), rows) is None

"""A pure-Python fixpoint to compare with."""

from __future__ import annotations

from collections import Counter

from ruleloom.model import RuleSet, Var


def matches(atom, triple, binding):
    out = dict(binding)
    for term, value in zip(atom.terms, triple, strict=True):
        if isinstance(term, Var):
            if out.setdefault(term.name, value) != value:
                return None
        elif term != value:
            return None
    return out


def instantiations(rules: RuleSet, triples: set) -> list[tuple]:
    found = []
    for rule in rules.rules:
        bindings = [{}]
        for atom in rule.body:
            bindings = [m for b in bindings for t in triples if (m := matches(atom, t, b)) is not None]
        found += [tuple(b[t.name] if isinstance(t, Var) else t for t in rule.head.terms) for b in bindings]
    return found


def closure(rules: RuleSet, triples) -> set:
    known = set(triples)
    while True:
        new = set(instantiations(rules, known)) - known
        if not new:
            return known
        known |= new


def counts(rules: RuleSet, triples) -> dict:
    known = closure(rules, triples)
    total = Counter(instantiations(rules, known))
    total.update(set(triples))
    return dict(total)

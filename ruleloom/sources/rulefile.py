"""Rule files: one rule a line, ``head :- atom, atom``; blank lines and # comments are skipped.

A term is ?variable, an id, <iri>, prefix:name, _:bnode or a quoted literal. ``*`` behind an atom
marks it as schema.
"""

from __future__ import annotations

import re
from importlib import resources

from ..functions.terms import PREFIXES
from ..model import Atom, Rule, RuleSet, Term, Var

TERM = re.compile(r'\?(\w+)|(-?\d+)(?=[\s)]|$)|(<[^>]*>)|(_:[^\s)]+)|("(?:[^"\\]|\\.)*"[^\s)]*)|([A-Za-z][\w-]*):([^\s)]+)')
ATOM = re.compile(r'\(((?:[^()"<]|<[^>]*>|"(?:[^"\\]|\\.)*")*)\)\s*(\*?)')


def term(match: re.Match, prefixes: dict[str, str]) -> Term:
    name, number, iri, bnode, literal, prefix, local = match.groups()
    if name:
        return Var(name)
    if number:
        return int(number)
    if prefix:
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}:")
        return f"<{prefixes[prefix]}{local}>"
    return iri or bnode or literal


def atom(text: str, marked: str, prefixes: dict[str, str]) -> Atom:
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TERM.match(text, at)
        if not m:
            raise ValueError(f"not a term: {text[at:]!r}")
        found.append(term(m, prefixes))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    if len(found) != 3:
        raise ValueError(f"an atom has three terms: ({text})")
    return Atom(*found, schema=bool(marked))


def parse_rule(line: str, number: int, prefixes: dict[str, str] | None = None) -> Rule:
    names = PREFIXES | (prefixes or {})
    head, mark, body = line.partition(":-")
    if not mark:
        raise ValueError(f"no ':-' in {line!r}")
    left = ATOM.findall(head)
    right = ATOM.findall(body)
    if len(left) != 1 or re.sub(r"[\s,]", "", ATOM.sub("", body)):
        raise ValueError(f"not a rule: {line!r}")
    return Rule(number, atom(*left[0], names), tuple(atom(*a, names) for a in right))


def parse_rules(text: str, prefixes: dict[str, str] | None = None) -> RuleSet:
    lines = [x.strip() for x in text.splitlines()]
    kept = [x for x in lines if x and not x.startswith("#")]
    return RuleSet(tuple(parse_rule(x, k, prefixes) for k, x in enumerate(kept, 1)))


def read_rules(path: str, prefixes: dict[str, str] | None = None) -> RuleSet:
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read(), prefixes)


def rdfs() -> RuleSet:
    """The RDFS rules."""
    return parse_rules(resources.files("ruleloom").joinpath("rulesets/rdfs.rules").read_text(encoding="utf-8"))

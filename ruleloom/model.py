"""Terms, atoms, rules and rule sets, and the schemas of the tables that hold triples."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Text triples, encoded triples, stored triples and the dictionary.
TEXT_TRIPLE = "s string, p string, o string"
TRIPLE = "s bigint, p bigint, o bigint"
STORED = "s bigint, p bigint, o bigint, step int, cnt bigint, is_explicit boolean"
DICTIONARY = "id bigint, term string"
SPO = ["s", "p", "o"]


@dataclass(frozen=True)
class Var:
    name: str


#: A constant is an id (int) or a term's text (str).
Term = Var | int | str


@dataclass(frozen=True)
class Atom:
    """A triple pattern; ``schema`` marks atoms whose matches are expected to be few."""

    s: Term
    p: Term
    o: Term
    schema: bool = False

    @property
    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    @property
    def variables(self) -> list[str]:
        """Names in order of first use, without repeats."""
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))


@dataclass(frozen=True)
class Rule:
    number: int
    head: Atom
    body: tuple[Atom, ...]

    def __post_init__(self):
        bound = {v for a in self.body for v in a.variables}
        if not self.body:
            raise ValueError(f"rule {self.number} has no body")
        if loose := [v for v in self.head.variables if v not in bound]:
            raise ValueError(f"rule {self.number}: {', '.join(loose)} in the head is not bound by the body")

    @property
    def kind(self) -> str:
        """schema (only marked atoms), generic (none) or mixed."""
        marked = sum(a.schema for a in self.body)
        return "schema" if marked == len(self.body) else "mixed" if marked else "generic"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def of_kind(self, kind: str) -> list[Rule]:
        return [r for r in self.rules if r.kind == kind]

    def schema_atoms(self) -> list[Atom]:
        return list(dict.fromkeys(a for r in self.rules for a in r.body if a.schema))

    def constants(self) -> set[Term]:
        return {t for r in self.rules for a in (r.head, *r.body) for t in a.terms if not isinstance(t, Var)}

    def mapped(self, ids: dict) -> RuleSet:
        """The rules with constants replaced; ones that ``ids`` lacks become a value that no triple has."""
        swap = lambda t: t if isinstance(t, Var) else ids.get(t, -1)
        atom = lambda a: Atom(*map(swap, a.terms), a.schema)
        return RuleSet(tuple(Rule(r.number, atom(r.head), tuple(map(atom, r.body))) for r in self.rules))

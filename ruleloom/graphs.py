"""Graphs made from relational tables, as SQL that Spark and DuckDB both run.

Table names stand in braces: Spark binds them to DataFrames, DuckDB to its views. Terms are built
from keys, so they are stable, and literals are escaped as in N-Triples.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions.terms import DOMAIN, RANGE, SUBCLASS, SUBPROPERTY, TYPE

EX = "http://ex/"


def node(kind: str, *keys: str) -> str:
    return f"concat('<{EX}{kind}/', {", '-', ".join(keys)}, '>')"


def named(name: str) -> str:
    return f"'<{EX}{name}>'"


def _edge(s: str, p: str, o: str, table: str) -> str:
    return f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {{{table}}}"


def _facts(rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o" for s, p, o in rows)


IS = f"'{TYPE}'"
BELOW, UNDER = f"'{SUBCLASS}'", f"'{SUBPROPERTY}'"
LINE = node("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "year(l_shipdate)", "month(l_shipdate)", "day(l_shipdate)")
LEAF = "concat('<http://ex/class/', replace(p_brand, '#', ''), '_', p_type, '>')"
BRAND = "concat('<http://ex/class/', replace(p_brand, '#', ''), '>')"
KIND = "concat('<http://ex/class/', p_type, '>')"

CUSTOMERS = " UNION ALL ".join(
    [
        _edge(node("customer", "c_custkey"), named("custNation"), node("nation", "c_nationkey"), "customer"),
        _edge(node("customer", "c_custkey"), IS, node("class", "c_mktsegment"), "customer"),
        _edge(node("nation", "n_nationkey"), named("inRegion"), node("region", "n_regionkey"), "nation"),
    ]
)
SUPPLIERS = _edge(node("supplier", "s_suppkey"), named("suppNation"), node("nation", "s_nationkey"), "supplier")
ORDERS = _edge(node("order", "o_orderkey"), named("placedBy"), node("customer", "o_custkey"), "orders")
PARTS = _edge(node("part", "p_partkey"), IS, LEAF, "part")
LINES = " UNION ALL ".join(
    [
        _edge(LINE, named("ofOrder"), node("order", "l_orderkey"), "lineitem"),
        _edge(LINE, named("ofPart"), node("part", "l_partkey"), "lineitem"),
        _edge(LINE, named("bySupplier"), node("supplier", "l_suppkey"), "lineitem"),
    ]
)
EVENTS = " UNION ALL ".join(
    [
        _edge(node("event", "event_id"), named("byUser"), node("user", "user_id"), "events"),
        _edge(node("event", "event_id"), IS, node("class", "event_type"), "events"),
    ]
)
CLASSES = " UNION ALL ".join(
    [
        _edge(LEAF, BELOW, BRAND, "part"),
        _edge(LEAF, BELOW, KIND, "part"),
        _edge(BRAND, BELOW, named("class/Part"), "part"),
        _edge(KIND, BELOW, named("class/Part"), "part"),
        _edge(node("class", "c_mktsegment"), BELOW, named("class/Customer"), "customer"),
        _facts(
            [
                (named("class/Part"), BELOW, named("class/Product")),
                (named("class/Product"), BELOW, named("class/Thing")),
                (named("class/Customer"), BELOW, named("class/Agent")),
                (named("class/Supplier"), BELOW, named("class/Agent")),
                (named("class/Agent"), BELOW, named("class/Thing")),
            ]
        ),
    ]
)
PROPERTIES = _facts(
    [
        (named("custNation"), UNDER, named("locatedIn")),
        (named("suppNation"), UNDER, named("locatedIn")),
        (named("inRegion"), UNDER, named("locatedIn")),
        (named("locatedIn"), UNDER, named("relatedTo")),
    ]
)
SIGNATURES = _facts(
    [
        (named("placedBy"), f"'{DOMAIN}'", named("class/Order")),
        (named("placedBy"), f"'{RANGE}'", named("class/Customer")),
        (named("ofOrder"), f"'{RANGE}'", named("class/Order")),
        (named("ofPart"), f"'{RANGE}'", named("class/Part")),
        (named("bySupplier"), f"'{RANGE}'", named("class/Supplier")),
        (named("suppNation"), f"'{DOMAIN}'", named("class/Supplier")),
        (named("locatedIn"), f"'{RANGE}'", named("class/Place")),
    ]
)
#: Every part's key below half of it: as deep as the logarithm of the number of parts.
TAXONOMY = (
    "SELECT concat('<http://ex/c/', p_partkey, '>') AS s, " + BELOW + " AS p,"
    " concat('<http://ex/c/', cast(floor(p_partkey / 2) as int), '>') AS o FROM {part} WHERE p_partkey >= 2"
)
SCHEMA = " UNION ALL ".join([CLASSES, PROPERTIES, SIGNATURES])
CORE = " UNION ALL ".join([CUSTOMERS, SUPPLIERS, ORDERS, PARTS, SCHEMA])
FULL = " UNION ALL ".join([CORE, LINES, EVENTS])

ESCAPED = (
    "replace(replace(replace(replace(replace({0}, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))),"
    " chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't'))"
)
#: Documents as literals with language tags, and names as plain ones.
LITERALS = " UNION ALL ".join(
    [
        f"SELECT {node('document', 'doc_id')} AS s, {named('text')} AS p,"
        f" concat(chr(34), {ESCAPED.format('text')}, chr(34), '@', lang) AS o FROM {{documents}}",
        f"SELECT {node('customer', 'c_custkey')} AS s, {named('name')} AS p, concat(chr(34), c_name, chr(34)) AS o FROM {{customer}}",
        f"SELECT concat('_:b', n_nationkey) AS s, {named('label')} AS p, concat(chr(34), n_name, chr(34), '^^<http://ex/string>') AS o FROM {{nation}}",
    ]
)
#: Lines that are no triples: a literal as subject, no dot, an unclosed literal, a word.
BROKEN = " UNION ALL ".join(
    [
        f"SELECT concat(chr(34), n_name, chr(34), ' <{EX}p> <{EX}o> .') AS value FROM {{nation}}",
        f"SELECT concat('<{EX}s> <{EX}p> <{EX}', n_nationkey, '>') AS value FROM {{nation}}",
        f"SELECT concat('<{EX}s> <{EX}p> ', chr(34), n_name, ' .') AS value FROM {{nation}}",
        "SELECT n_name AS value FROM {nation}",
    ]
)


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of a folder."""
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_in(sql)})


def once(sql: str) -> str:
    """The same rows from fewer scans: edges of one table that have a subject in common are read together, and it is made once."""
    parts, found = [], {}
    for part in sql.split(" UNION ALL "):
        edge = re.fullmatch(r"SELECT (.+) AS s, (.+) AS p, (.+) AS o FROM (\{\w+\})", part)
        if edge is None:
            parts.append(part)
        else:
            found.setdefault((edge[1], edge[4]), []).append(f"named_struct('p', {edge[2]}, 'o', {edge[3]})")
    for (s, table), edges in found.items():
        parts.append(f"SELECT s, inline(edges) FROM (SELECT {s} AS s, array({', '.join(edges)}) AS edges FROM {table})")
    return " UNION ALL ".join(parts)


def duck(sql: str) -> str:
    """The SQL as DuckDB takes it."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)

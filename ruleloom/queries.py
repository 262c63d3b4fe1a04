"""Registered queries of the rule engine, with DuckDB SQL for each.

Queries start from graphs made of the relational tables (``graphs``); results are text wherever ids
could hide an error. The SQL computes the same from the tables on its own: hierarchies by recursive
UNION, the rest by joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs as g
from .functions import terms
from .model import SPO, Atom, RuleSet, Var
from .operators import bulk
from .operators import dictionary as d
from .operators import triples as t
from .plans import closure as c
from .plans import incremental as inc
from .plans.compiler import Source, apply_once, instantiations
from .plans.store import KnowledgeBase
from .sources import ntriples, rulefile, tables
from .sources.lineage import fresh_path, in_pass, passes_for, removed, written, written_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
duck = g.duck


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def graph(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return g.run(spark, sf_dir, f"SELECT DISTINCT s, p, o FROM ({sql})")


def rows_of(sql: str) -> str:
    return f"(SELECT DISTINCT s, p, o FROM ({duck(sql)}) u)"


TYPE, RANGE, DOMAIN, SUBPROPERTY, SUBCLASS = terms.TYPE, terms.RANGE, terms.DOMAIN, terms.SUBPROPERTY, terms.SUBCLASS


def rdfs_sql(sql: str, select: str = "SELECT s, p, o FROM k") -> str:
    """``select`` over k, the RDFS closure of a graph, and t, the graph."""
    return f"""
WITH RECURSIVE t AS {rows_of(sql)},
sp(s, o) AS (SELECT s, o FROM t WHERE p = '{SUBPROPERTY}' UNION SELECT sp.s, t.o FROM sp JOIN t ON t.s = sp.o AND t.p = '{SUBPROPERTY}'),
sc(s, o) AS (SELECT s, o FROM t WHERE p = '{SUBCLASS}' UNION SELECT sc.s, t.o FROM sc JOIN t ON t.s = sc.o AND t.p = '{SUBCLASS}'),
e AS (SELECT s, p, o FROM t UNION SELECT t.s, sp.o, t.o FROM t JOIN sp ON sp.s = t.p),
y AS (SELECT s, o FROM e WHERE p = '{TYPE}'
  UNION SELECT e.s, x.o FROM e JOIN t x ON x.p = '{DOMAIN}' AND x.s = e.p
  UNION SELECT e.o, x.o FROM e JOIN t x ON x.p = '{RANGE}' AND x.s = e.p),
k AS (SELECT s, p, o FROM e UNION SELECT s, '{TYPE}', o FROM y UNION SELECT y.s, '{TYPE}', sc.o FROM y JOIN sc ON sc.s = y.o
  UNION SELECT s, '{SUBPROPERTY}', o FROM sp UNION SELECT s, '{SUBCLASS}', o FROM sc)
{select}"""


#: The body matches of each RDFS rule over a table x, as (s, p, o).
RULE_SQL = {
    "rdfs9": "SELECT a.s, '{type}' AS p, b.o FROM {x} a JOIN {x} b ON b.p = '{sub_class}' AND b.s = a.o WHERE a.p = '{type}'",
    "rdfs11": "SELECT a.s, '{sub_class}' AS p, b.o FROM {x} a JOIN {x} b ON b.p = '{sub_class}' AND b.s = a.o WHERE a.p = '{sub_class}'",
    "rdfs7": "SELECT a.s, b.o AS p, a.o FROM {x} a JOIN {x} b ON b.p = '{sub_property}' AND b.s = a.p",
    "rdfs5": "SELECT a.s, '{sub_property}' AS p, b.o FROM {x} a JOIN {x} b ON b.p = '{sub_property}' AND b.s = a.o WHERE a.p = '{sub_property}'",
    "rdfs2": "SELECT a.s, '{type}' AS p, b.o FROM {x} a JOIN {x} b ON b.p = '{domain}' AND b.s = a.p",
    "rdfs3": "SELECT a.o AS s, '{type}' AS p, b.o FROM {x} a JOIN {x} b ON b.p = '{range}' AND b.s = a.p",
}


def rule_sql(name: str, x: str) -> str:
    return RULE_SQL[name].format(x=x, type=TYPE, sub_class=SUBCLASS, sub_property=SUBPROPERTY, domain=DOMAIN, range=RANGE)


def rules_sql(x: str) -> str:
    return " UNION ALL ".join(rule_sql(n, x) for n in RULE_SQL)


COUNTS = f"SELECT s, p, o, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT s, p, o FROM t UNION ALL {rules_sql('k')}) GROUP BY s, p, o"


def only(name: str) -> RuleSet:
    """One of the RDFS rules."""
    return RuleSet((rulefile.rdfs().rules[list(RULE_SQL).index(name)],))


# ---- N-Triples --------------------------------------------------------------------------------

NT = g.LITERALS + " UNION ALL " + g.CUSTOMERS


def nt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = ntriples.as_lines(g.run(spark, sf_dir, NT))
    odd = spark.createDataFrame([("",), ("# a comment",), ("   ",)], "value string")
    return good.unionByName(g.run(spark, sf_dir, g.BROKEN)).unionByName(odd)


@query(f"SELECT s, p, o FROM ({duck(NT)})")
def nt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.parse(nt_lines(spark, sf_dir)).filter("ok").select(*SPO)


@query(f"SELECT (SELECT count(*) FROM ({duck(NT)})) AS parsed, (SELECT count(*) FROM ({duck(g.BROKEN)})) AS malformed")
def nt_malformed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.counts(ntriples.parse(nt_lines(spark, sf_dir)))


@query(f"SELECT s, p, o, concat('_:dataant', substr(s, 3)) AS renamed FROM ({duck(g.LITERALS)}) WHERE s LIKE '\\_:%' ESCAPE '\\'")
def nt_bnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.run(spark, sf_dir, g.LITERALS).filter(terms.kind(F.col("s")) == "bnode")
    return rows.withColumn("renamed", ntriples.own_bnodes(F.col("s"), F.lit("data/a.nt")))


@query(f"SELECT concat(s, ' ', p, ' ', o, ' .') AS value FROM {rows_of(g.CORE)}")
def nt_lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to ids and back to lines."""
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.CORE))
    return ntriples.as_lines(d.decode(encoded, names))


@query(
    f"SELECT CASE WHEN o LIKE '<%' THEN 'iri' WHEN o LIKE '\\_:%' ESCAPE '\\' THEN 'bnode' ELSE 'literal' END AS kind,"
    f" CASE WHEN p = {g.named('text')} THEN regexp_extract(o, '@([a-z]+)$', 1) END AS lang,"
    f" CASE WHEN p = {g.named('label')} THEN '<http://ex/string>' END AS datatype, CAST(count(*) AS BIGINT) AS n"
    f" FROM ({duck(NT)}) GROUP BY ALL"
)
def term_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o")
    rows = g.run(spark, sf_dir, NT).select(terms.kind(o).alias("kind"), terms.language(o).alias("lang"), terms.datatype(o).alias("datatype"))
    return rows.groupBy("kind", "lang", "datatype").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT s, p, o FROM ({duck(g.FULL)})")
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.distinct_text(g.run(spark, sf_dir, g.FULL))


@query(f"SELECT DISTINCT concat(s, ' ', p, ' ', o, ' .') AS value FROM ({duck(g.FULL)}) ORDER BY value")
def sort_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sort_distinct(ntriples.as_lines(g.run(spark, sf_dir, g.FULL)))


# ---- dictionary -------------------------------------------------------------------------------

STANDARD = "(VALUES " + ", ".join(f"(CAST({k} AS BIGINT), '{v}')" for k, v in terms.STANDARD_TERMS.items()) + ") AS std(id, term)"
TERMS_OF = "SELECT s AS term FROM {0} UNION SELECT p FROM {0} UNION SELECT o FROM {0}"


def dictionary_ctes(sql: str) -> str:
    return f"""t AS {rows_of(sql)}, std AS (SELECT * FROM {STANDARD}), n AS ({TERMS_OF.format('t')}),
dict AS (SELECT id, term FROM std UNION ALL
  SELECT CAST(199 + row_number() OVER (ORDER BY term) AS BIGINT), term FROM n WHERE term NOT IN (SELECT term FROM std))"""


@query(f"SELECT id, term FROM {STANDARD}")
def dict_standard_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.standard_terms(spark)


@query(f"WITH {dictionary_ctes(g.FULL)} SELECT id, term FROM dict")
def dict_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.build(written(graph(spark, sf_dir, g.FULL), "graph"))


@query(
    f"WITH {dictionary_ctes(g.FULL)} SELECT a.id AS s, b.id AS p, c.id AS o FROM t JOIN dict a ON a.term = t.s JOIN dict b ON b.term = t.p JOIN dict c ON c.term = t.o"
)
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.compress(spark, g.run(spark, sf_dir, g.FULL))[0]


@query(
    f"WITH {dictionary_ctes(g.CUSTOMERS)}, u AS {rows_of(g.ORDERS)}, m AS ({TERMS_OF.format('u')}),"
    " more AS (SELECT CAST((SELECT max(id) FROM dict) + row_number() OVER (ORDER BY term) AS BIGINT) AS id, term FROM m WHERE term NOT IN (SELECT term FROM dict))"
    " SELECT id, term FROM dict UNION ALL SELECT id, term FROM more"
)
def dict_encode_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = written(d.build(graph(spark, sf_dir, g.CUSTOMERS)), "dictionary")
    return d.build(graph(spark, sf_dir, g.ORDERS), first)


@query(
    f"WITH {dictionary_ctes(g.CORE)} SELECT term, pos, CASE pos WHEN 'S' THEN concat(id, ' -1 -1') WHEN 'P' THEN concat('-1 ', id, ' -1') ELSE concat('-1 -1 ', id) END AS query"
    " FROM dict JOIN (SELECT DISTINCT p AS w, 'P' AS pos FROM t UNION ALL SELECT DISTINCT o, 'O' FROM t UNION ALL SELECT DISTINCT s, 'S' FROM t) r ON r.w = dict.term"
)
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(graph(spark, sf_dir, g.CORE), "graph")
    asked = rows.select(F.explode(F.array(*[F.struct(F.col(x).alias("term"), F.lit(x.upper()).alias("pos")) for x in SPO])).alias("r"))
    return d.lookup(d.build(rows), asked.select("r.*").distinct())


@query(
    f"WITH t AS {rows_of(g.FULL)}, std AS (SELECT * FROM {STANDARD}), n AS (SELECT term, count(*) AS n FROM (SELECT s AS term FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t)"
    " WHERE term NOT IN (SELECT term FROM std) GROUP BY term HAVING count(*) > 100),"
    " r AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS k FROM n)"
    " SELECT CAST(99 + k AS BIGINT) AS id, term, CAST(n AS BIGINT) AS n FROM r WHERE k <= 100"
)
def dict_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.popular_terms(graph(spark, sf_dir, g.FULL), threshold=100)


@query(f"SELECT s, p, o FROM {rows_of(g.FULL)}")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.run(spark, sf_dir, g.FULL)
    passes = passes_for(rows)
    if passes > 1 and (coded := bulk.compress(spark, rows, 1000, g.run(spark, sf_dir, g.once(g.FULL)))):
        return bulk.decode(coded)
    encoded, names = d.compress(spark, rows, threshold=1000)
    return d.decode(encoded, names, passes=passes)


#: Ids with the popular terms of a graph t in front.
POPULAR_CTES = f"""t AS {rows_of(g.FULL)}, std AS (SELECT * FROM {STANDARD}), m AS (SELECT s AS term FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t),
c AS (SELECT term, count(*) AS n FROM m WHERE term NOT IN (SELECT term FROM std) GROUP BY term),
pop AS (SELECT term, 99 + row_number() OVER (ORDER BY n DESC, term) AS id FROM c WHERE n > 300 QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 100),
dict AS (SELECT id, term FROM std UNION ALL SELECT CAST(id AS BIGINT), term FROM pop UNION ALL
  SELECT CAST(199 + row_number() OVER (ORDER BY term) AS BIGINT), term FROM c WHERE term NOT IN (SELECT term FROM pop))"""


@query(
    f"WITH {POPULAR_CTES} SELECT a.id AS s, b.id AS p, c.id AS o FROM t JOIN dict a ON a.term = t.s JOIN dict b ON b.term = t.p JOIN dict c ON c.term = t.o"
)
def encode_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popular terms get low ids and are looked up without a shuffle."""
    return d.compress(spark, g.run(spark, sf_dir, g.FULL), threshold=300)[0]


@query(f"SELECT s, p, o FROM {rows_of(g.FULL)}")
def decode_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a sample shows to be popular are looked up without a shuffle."""
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.FULL))
    return d.decode(written(encoded, "encoded"), names, threshold=30, fraction=0.1)


@query(
    f"WITH {dictionary_ctes(g.FULL)}, m AS (SELECT s AS term FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t),"
    " c AS (SELECT id, dict.term, count(*) AS n FROM m JOIN dict ON dict.term = m.term GROUP BY id, dict.term HAVING count(*) >= 100)"
    " SELECT id, term, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, id) <= 100"
)
def popular_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that occur most when decoding, with their text."""
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.FULL))
    ids = written(d.popular_ids(encoded, 100), "ids")
    return d.texts_of_ids(names, ids).join(ids, "id").select("id", "term", "n")


# ---- patterns and index -----------------------------------------------------------------------

NATION, PLACED = f"<{g.EX}nation/3>", f"<{g.EX}placedBy>"


def pattern(name: str, s=None, p=None, o=None) -> None:
    where = " AND ".join(f"{k} = '{v}'" for k, v in (("s", s), ("p", p), ("o", o)) if v) or "true"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t.pattern_scan(graph(spark, sf_dir, g.CORE), s, p, o)

    run.__name__ = f"pattern_{name}"
    query(f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE {where}")(run)


pattern("all")
pattern("s", s=f"<{g.EX}customer/7>")
pattern("p", p=PLACED)
pattern("o", o=NATION)
pattern("sp", s=f"<{g.EX}customer/7>", p=TYPE)
pattern("so", s=f"<{g.EX}nation/3>", o=f"<{g.EX}region/1>")
pattern("po", p=TYPE, o=f"<{g.EX}class/BUILDING>")
pattern("spo", s=f"<{g.EX}class/Part>", p=SUBCLASS, o=f"<{g.EX}class/Product>")

ASKED = (
    "SELECT CAST(n_nationkey AS INT) AS qid, '-1' AS s, '-1' AS p, concat('<http://ex/nation/', n_nationkey, '>') AS o FROM {nation}"
    f" UNION ALL SELECT CAST(100 + n_nationkey AS INT), concat('<http://ex/customer/', n_nationkey, '>'), '{TYPE}', '-1' FROM {{nation}}"
    f" UNION ALL SELECT CAST(200 + r_regionkey AS INT), '-1', '<{g.EX}inRegion>', '-1' FROM {{region}}"
)


@query(
    f"SELECT qid, t.s, t.p, t.o FROM {rows_of(g.CORE)} t JOIN ({duck(ASKED)}) q ON (q.s = '-1' OR q.s = t.s) AND (q.p = '-1' OR q.p = t.p) AND (q.o = '-1' OR q.o = t.o)"
)
def pattern_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = g.run(spark, sf_dir, ASKED).withColumns({x: F.when(F.col(x) != "-1", F.col(x)).otherwise("-1") for x in SPO})
    return t.answer_patterns(graph(spark, sf_dir, g.CORE), asked)


@query(
    " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS perm, {x[0]} AS a, {x[1]} AS b, {x[2]} AS c, CAST(0 AS INT) AS step, CAST(1 AS BIGINT) AS cnt FROM {rows_of(g.CORE)}"
        for k, x in enumerate(t.PERMUTATIONS)
    )
)
def permute_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.permute(graph(spark, sf_dir, g.CORE))


@query(f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE p IN ({', '.join(repr(x) for x in terms.SCHEMA_PREDICATES)})")
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.schema_filter(graph(spark, sf_dir, g.CORE), terms.SCHEMA_PREDICATES)


@query(f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE p IN ({', '.join(repr(x) for x in terms.SCHEMA_PREDICATES)})")
def schema_filter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.schema_filter_rules(graph(spark, sf_dir, g.CORE), rulefile.rdfs().schema_atoms())


#: The lines of orders to parts with repeats: step is the line's number, cnt its whole quantity.
COUNTED = (
    "SELECT concat('<http://ex/order/', l_orderkey, '>') AS s, '<http://ex/has>' AS p, concat('<http://ex/part/', l_partkey, '>') AS o,"
    " CAST(l_linenumber AS INT) AS step, CAST(floor(l_quantity) AS BIGINT) AS cnt FROM {lineitem}"
)


@query(f"SELECT s, p, o, min(step) AS step, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({duck(COUNTED)}) GROUP BY s, p, o")
def sum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sum_counts(g.run(spark, sf_dir, COUNTED))


@query(f"SELECT s, p, o, min(step) AS step FROM ({duck(COUNTED)}) GROUP BY s, p, o")
def remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.remove_duplicates(g.run(spark, sf_dir, COUNTED))


@query(
    f"SELECT s, p, o, min(step) AS step, CAST(count(*) FILTER (WHERE step >= 3) AS BIGINT) AS cnt FROM ({duck(COUNTED)}) GROUP BY s, p, o HAVING count(*) FILTER (WHERE step >= 3) > 0"
)
def derivation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.derivation_counts(g.run(spark, sf_dir, COUNTED), 3)


@query(f"SELECT s, p, o, step, cnt FROM ({duck(COUNTED)}) WHERE step >= 3")
def filter_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filter_step(g.run(spark, sf_dir, COUNTED), 3)


@query(f"SELECT o, max(step) AS step FROM ({duck(COUNTED)}) GROUP BY o")
def max_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.max_step(g.run(spark, sf_dir, COUNTED), "o")


@query(
    f"SELECT a.s, a.p, a.o, coalesce(b.step, a.step) AS step, a.cnt FROM ({duck(COUNTED)}) a LEFT JOIN"
    f" (SELECT s, p, o, min(step) AS step FROM ({duck(COUNTED)}) WHERE cnt > 25 GROUP BY s, p, o) b ON a.s = b.s AND a.p = b.p AND a.o = b.o"
)
def replace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.run(spark, sf_dir, COUNTED)
    return t.replace_steps(rows, rows.filter("cnt > 25")).select(*SPO, "step", "cnt")


@query(f"SELECT s, p, o, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM ({duck(COUNTED)}) UNION ALL SELECT * FROM ({duck(COUNTED)}) WHERE step = 1) GROUP BY s, p, o")
def multiset_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.run(spark, sf_dir, COUNTED)
    return t.multiset_add(rows, rows.filter("step = 1"))


#: Counted triples merged to one row each, and those of quantity above 25 alone, as table and change.
MERGED = f"SELECT s, p, o, min(step) AS step, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({duck(COUNTED)}) GROUP BY s, p, o"
CHANGE = f"SELECT s, p, o, step, cnt FROM ({duck(COUNTED)}) WHERE cnt > 25"


COUNTED_IDS = (
    "SELECT l_orderkey AS s, CAST(l_linenumber AS BIGINT) AS p, l_partkey AS o, CAST(l_linenumber AS INT) AS step, CAST(floor(l_quantity) AS BIGINT) AS cnt FROM {lineitem}"
)


def change(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = g.run(spark, sf_dir, COUNTED)
    return t.sum_counts(rows.filter("step > 2")), rows.filter("cnt > 25")


SMALL = MERGED.replace(" GROUP BY", " WHERE step > 2 GROUP BY")


@query(
    f"WITH a AS ({SMALL}), b AS ({CHANGE}) SELECT s, p, o, step, cnt FROM a UNION ALL"
    " SELECT s, p, o, min(step) AS step, min(cnt) AS cnt FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.s = b.s AND a.p = b.p AND a.o = b.o) GROUP BY s, p, o"
)
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.insert_absent(*change(spark, sf_dir))


@query(f"SELECT s, p, o, min(step) AS step, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM ({SMALL}) UNION ALL SELECT * FROM ({CHANGE})) GROUP BY s, p, o")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.upsert_counts(*change(spark, sf_dir))


@query(
    f"WITH a AS ({SMALL}), b AS (SELECT s AS s2, p AS p2, o AS o2, sum(cnt) AS n FROM ({CHANGE}) GROUP BY ALL)"
    " SELECT s, p, o, step, CAST(cnt - coalesce(n, 0) AS BIGINT) AS cnt FROM a LEFT JOIN b ON s = s2 AND p = p2 AND o = o2 WHERE cnt > coalesce(n, 0)"
)
def decrease_or_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.decrease_or_remove(*change(spark, sf_dir))


@query(
    f"WITH a AS (SELECT s, p, o, step - 1 AS step, cnt FROM ({MERGED})), b AS ({CHANGE})"
    " SELECT * FROM a WHERE step = 0 OR NOT EXISTS (SELECT 1 FROM b WHERE a.s = b.s AND a.p = b.p AND a.o = b.o)"
)
def remove_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.run(spark, sf_dir, COUNTED)
    return t.remove_derived(t.sum_counts(rows).withColumn("step", F.col("step") - 1), rows.filter("cnt > 25"))


@query(f"SELECT * FROM {rows_of(g.FULL)} EXCEPT SELECT * FROM {rows_of(g.CORE)}")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.difference(graph(spark, sf_dir, g.FULL), graph(spark, sf_dir, g.CORE))


@query(f"SELECT * FROM {rows_of(g.FULL)} INTERSECT SELECT * FROM {rows_of(g.CUSTOMERS + ' UNION ALL ' + g.TAXONOMY)}")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.intersection(graph(spark, sf_dir, g.FULL), graph(spark, sf_dir, g.CUSTOMERS + " UNION ALL " + g.TAXONOMY))


@query(f"SELECT * FROM {rows_of(g.CORE)} UNION SELECT * FROM {rows_of(g.TAXONOMY)}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.union(graph(spark, sf_dir, g.CORE), graph(spark, sf_dir, g.TAXONOMY))


@query(f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE p = '{TYPE}' AND o IN (SELECT s FROM {rows_of(g.CLASSES)})")
def acceptable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pattern_scan(graph(spark, sf_dir, g.CORE), p=TYPE)
    return t.acceptable(rows, "o", graph(spark, sf_dir, g.CLASSES), "s")


@query(
    f"WITH t AS {rows_of(g.CORE)}, n AS (SELECT term, count(*) AS n FROM (SELECT s AS term FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t) GROUP BY term) SELECT term, CAST(n AS BIGINT) AS n FROM n"
)
def count_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.count_terms(graph(spark, sf_dir, g.CORE))


@query(
    f"WITH t AS (SELECT * FROM {rows_of(g.CORE)} WHERE substr(md5(concat_ws(' ', s, p, o)), 1, 8) < '{int(0.1 * (1 << 32)):08x}'),"
    " n AS (SELECT s AS term FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t) SELECT term, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY term"
)
def sample_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a sample, which the triples' MD5 decides."""
    return t.count_terms(graph(spark, sf_dir, g.CORE), fraction=0.1)


# ---- rules ------------------------------------------------------------------------------------


def one_step(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = written(graph(spark, sf_dir, g.CORE), "graph")
        return apply_once(only(name), rows).select(*SPO).distinct()

    run.__name__ = f"{name}_one_step"
    query(f"WITH t AS {rows_of(g.CORE)} SELECT DISTINCT s, p, o FROM ({rule_sql(name, 't')})")(run)


for _name in RULE_SQL:
    one_step(_name)


@query(f"WITH t AS {rows_of(g.CORE)} SELECT s, p, o, CAST(count(*) AS BIGINT) AS cnt FROM ({rules_sql('t')}) GROUP BY s, p, o")
def one_step_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(graph(spark, sf_dir, g.CORE), "graph")
    return apply_once(rulefile.rdfs(), rows).groupBy(*SPO).agg(F.count("*").alias("cnt"))


@query(
    f"WITH t AS {rows_of(g.SCHEMA)} SELECT a.s AS a, a.o AS b, b.o AS c FROM t a JOIN t b ON b.s = a.o WHERE a.p = '{SUBCLASS}' AND b.p = '{SUBCLASS}'"
)
def schema_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of two schema atoms joined on their shared variable."""
    rows = graph(spark, sf_dir, g.SCHEMA)
    left = t.bindings(rows, Atom(Var("a"), SUBCLASS, Var("b"), True))
    return left.join(t.bindings(rows, Atom(Var("b"), SUBCLASS, Var("c"), True)), "b").select("a", "b", "c")


@query(
    f"WITH t AS (SELECT DISTINCT s, p, o, length(s) % 7 AS step FROM ({duck(g.SCHEMA)}))"
    f" SELECT a.s AS a, a.o AS b, b.o AS c, CAST(greatest(a.step, b.step) AS INT) AS step FROM t a JOIN t b ON b.s = a.o WHERE a.p = '{SUBCLASS}' AND b.p = '{SUBCLASS}'"
)
def schema_join_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As schema_join, with the later step of both sides (steps are made up from lengths)."""
    rows = graph(spark, sf_dir, g.SCHEMA).withColumn("step", F.length("s") % 7).filter(F.col("p") == F.lit(SUBCLASS))
    left = rows.select(F.col("s").alias("a"), F.col("o").alias("b"), "step")
    return t.schema_join(left, rows.select(F.col("s").alias("b"), F.col("o").alias("c"), "step"), ["b"]).select("a", "b", "c", "step")


def hierarchy_sql(sql: str, predicate: str) -> str:
    return (
        f"WITH RECURSIVE t AS {rows_of(sql)}, r(s, o) AS (SELECT s, o FROM t WHERE p = '{predicate}' UNION SELECT r.s, t.o FROM r JOIN t ON t.s = r.o AND t.p = '{predicate}')"
        f" SELECT s, '{predicate}' AS p, o FROM r"
    )


@query(hierarchy_sql(g.SCHEMA, SUBCLASS))
def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pattern_scan(c.closure(graph(spark, sf_dir, g.SCHEMA), only("rdfs11")), p=SUBCLASS).select(*SPO)


@query(hierarchy_sql(g.SCHEMA, SUBPROPERTY))
def subproperty_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pattern_scan(c.closure(graph(spark, sf_dir, g.SCHEMA), only("rdfs5")), p=SUBPROPERTY).select(*SPO)


@query(hierarchy_sql(g.TAXONOMY, SUBCLASS))
def deep_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy as deep as the logarithm of its size, by doubling paths."""
    edges = t.pattern_scan(graph(spark, sf_dir, g.TAXONOMY), p=SUBCLASS)
    return c.reach(edges).select("s", F.lit(SUBCLASS).alias("p"), "o")


@query(rdfs_sql(g.CORE))
def rdfs_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general fixpoint over ids, decoded."""
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.CORE))
    rules = rulefile.rdfs()
    rules = rules.mapped(d.ids_of(names, list(rules.constants())))
    return d.decode(c.closure(encoded, rules).select(*SPO), names)


def closed_in_bulk(coded: bulk.Coded, passes: int) -> bulk.Coded:
    """The RDFS closure, made distinct in passes by subject, each of which reads the encoded triples again."""
    triples = coded.triples
    ids = d.ids_of(coded.near, [TYPE, RANGE, DOMAIN, SUBPROPERTY, SUBCLASS])
    rules = rulefile.rdfs().mapped(ids)
    closed = c.rdfs_closure(triples, ids) if c.one_pass_holds(triples, ids) else c.closure(triples, rules).select(*SPO)
    # classes and properties have many members, so they must not lie in one bucket
    near = bulk.nearer(coded, triples.filter(F.col("p").isin(list(ids.values()))).select(F.col("o").alias("id")))
    out = bulk.keyed([closed.filter(in_pass(k, passes, F.col("s"))) for k in range(passes)], near, coded.buckets)
    removed(coded.keyed)
    return bulk.Coded(out, coded.names, near, coded.buckets)


@query(rdfs_sql(g.FULL))
def rdfs_closure_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph, over ids, reading instance triples once; the fixpoint if that doesn't hold."""
    rows = g.run(spark, sf_dir, g.FULL)
    passes = passes_for(rows)
    if passes > 1 and (coded := bulk.compress(spark, rows, whole=g.run(spark, sf_dir, g.once(g.FULL)))):
        return bulk.decode(closed_in_bulk(coded, -(-passes // 6)))
    encoded, names = d.compress(spark, rows)
    ids = d.ids_of(names, [TYPE, RANGE, DOMAIN, SUBPROPERTY, SUBCLASS])
    rules = rulefile.rdfs().mapped(ids)
    closed = c.rdfs_closure(encoded, ids) if c.one_pass_holds(encoded, ids) else c.closure(encoded, rules).select(*SPO)
    if passes > 1:
        # each part reads the triples again; ids take a third of the room that texts do in a shuffle
        few = -(-passes // 3)
        closed = written_parts([closed.filter(in_pass(k, few, F.col("s"))) for k in range(few)], "closed")
        removed(encoded)
    return d.decode(closed, names, passes=passes)


@query(rdfs_sql(g.CORE, COUNTS))
def rdfs_closure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.closure(graph(spark, sf_dir, g.CORE), rulefile.rdfs(), counting=True).select(*SPO, "cnt")


@query(
    rdfs_sql(
        g.CORE,
        " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS rule, CAST(count(*) AS BIGINT) AS n FROM ({rule_sql(x, 'k')}) HAVING count(*) > 0" for k, x in enumerate(RULE_SQL, 1)),
    )
)
def derivations_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.derivations_per_rule(graph(spark, sf_dir, g.CORE), rulefile.rdfs())


@query(rdfs_sql(g.CORE, f"SELECT s AS x FROM k WHERE p = '{TYPE}' AND o = '<{g.EX}class/Agent>'"))
def members_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of a class: encode, close, query by pattern, decode."""
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.CORE))
    rules = rulefile.rdfs()
    ids = d.ids_of(names, [*rules.constants(), f"<{g.EX}class/Agent>"])
    table = c.closure(encoded, rules.mapped(ids))
    found = t.pattern_scan(table, p=ids[TYPE], o=ids[f"<{g.EX}class/Agent>"]).select(*SPO)
    return d.decode(found, names).select(F.col("s").alias("x"))


@query(f"SELECT o AS s, '<{g.EX}hasOrder>' AS p, s AS o FROM {rows_of(g.ORDERS)} UNION SELECT s, p, o FROM {rows_of(g.ORDERS)}")
def generic_only_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rulefile.parse_rules(f"(?y <{g.EX}hasOrder> ?x) :- (?x <{g.EX}placedBy> ?y)")
    return c.closure(graph(spark, sf_dir, g.ORDERS), rules).select(*SPO)


MULTI = g.CUSTOMERS + " UNION ALL " + g.ORDERS


@query(
    f"WITH t AS {rows_of(MULTI)} SELECT DISTINCT a.s, '<{g.EX}orderedFrom>' AS p, d.o FROM t a JOIN t b ON b.s = a.o AND b.p = '<{g.EX}custNation>'"
    f" JOIN t d ON d.s = b.o AND d.p = '<{g.EX}inRegion>' WHERE a.p = '<{g.EX}placedBy>'"
)
def multi_atom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three atoms that are not schema."""
    rules = rulefile.parse_rules(
        f"(?x <{g.EX}orderedFrom> ?r) :- (?x <{g.EX}placedBy> ?c), (?c <{g.EX}custNation> ?n), (?n <{g.EX}inRegion> ?r)"
    )
    return t.pattern_scan(c.closure(graph(spark, sf_dir, MULTI), rules), p=f"<{g.EX}orderedFrom>").select(*SPO)


REPEATED = "SELECT concat('<http://ex/nation/', n_nationkey, '>') AS s, '<http://ex/near>' AS p, concat('<http://ex/nation/', n_regionkey, '>') AS o FROM {nation}"


@query(f"SELECT s, '{TYPE}' AS p, '<{g.EX}class/Loop>' AS o FROM ({duck(REPEATED)}) WHERE s = o")
def repeated_var_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rulefile.parse_rules(f"(?x rdf:type <{g.EX}class/Loop>) :- (?x <{g.EX}near> ?x)")
    return apply_once(rules, graph(spark, sf_dir, REPEATED)).select(*SPO)


BGP = f"""WITH t AS {rows_of(g.CORE)} SELECT a.s AS customer, b.o AS region FROM t a JOIN t b ON b.s = a.o AND b.p = '<{g.EX}inRegion>' WHERE a.p = '<{g.EX}custNation>'"""


@query(BGP)
def basic_graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunctive query is a rule's body: an extension that the compiler gives for nothing."""
    rule = rulefile.parse_rule(f"(?c <{g.EX}in> ?r) :- (?c <{g.EX}custNation> ?n), (?n <{g.EX}inRegion> ?r)", 1)
    source = Source(graph(spark, sf_dir, g.CORE), RuleSet((rule,)))
    return instantiations(rule, [source, source]).select(F.col("s").alias("customer"), F.col("o").alias("region"))


# ---- maintenance ------------------------------------------------------------------------------

#: What is added and removed: all suppliers with their facts, and two edges of the hierarchies.
DELTA = " UNION ALL ".join(
    [
        g.SUPPLIERS,
        f"SELECT {g.named('class/Customer')} AS s, {g.BELOW} AS p, {g.named('class/Agent')} AS o",
        f"SELECT {g.named('custNation')} AS s, {g.UNDER} AS p, {g.named('locatedIn')} AS o",
    ]
)
REST = f"SELECT s, p, o FROM ({g.CORE}) EXCEPT SELECT s, p, o FROM ({DELTA})"
COUNTED_CLOSURE = "SELECT s, p, o, cnt, e AS is_explicit FROM (" + COUNTS.replace(
    "GROUP BY s, p, o", "GROUP BY s, p, o) n LEFT JOIN (SELECT s AS s2, p AS p2, o AS o2, true AS e FROM t) x ON s = s2 AND p = p2 AND o = o2"
)


def maintained(spark: SparkSession, sf_dir: str, sql: str, counting: bool = False) -> DataFrame:
    return written(c.closure(graph(spark, sf_dir, sql), rulefile.rdfs(), counting), "kb")


@query(rdfs_sql(g.CORE))
def incr_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maintained(spark, sf_dir, REST)
    return inc.add(table, graph(spark, sf_dir, DELTA), rulefile.rdfs()).select(*SPO)


@query(rdfs_sql(g.CORE, COUNTS))
def incr_add_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maintained(spark, sf_dir, REST, counting=True)
    return inc.add(table, graph(spark, sf_dir, DELTA), rulefile.rdfs(), counting=True).select(*SPO, "cnt")


@query(rdfs_sql(REST))
def incr_remove_dred(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maintained(spark, sf_dir, g.CORE)
    return inc.remove(table, graph(spark, sf_dir, DELTA), rulefile.rdfs()).select(*SPO)


@query(rdfs_sql(REST, COUNTS))
def incr_remove_dred_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maintained(spark, sf_dir, g.CORE, counting=True)
    return inc.remove(table, graph(spark, sf_dir, DELTA), rulefile.rdfs(), counting=True).select(*SPO, "cnt")


@query(rdfs_sql(REST, COUNTS))
def incr_remove_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maintained(spark, sf_dir, g.CORE, counting=True)
    return inc.remove_counting(table, graph(spark, sf_dir, DELTA), rulefile.rdfs()).select(*SPO, "cnt")


@query(rdfs_sql(g.CORE, "SELECT k.s, k.p, k.o, x.s IS NOT NULL AS is_explicit FROM k LEFT JOIN t x ON x.s = k.s AND x.p = k.p AND x.o = k.o"))
def incr_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and added again."""
    rules, delta = rulefile.rdfs(), written(graph(spark, sf_dir, DELTA), "delta")
    table = written(inc.remove(maintained(spark, sf_dir, g.CORE), delta, rules), "kb")
    return inc.add(table, delta, rules).select(*SPO, "is_explicit")


@query(
    rdfs_sql(
        g.CORE,
        f"SELECT concat_ws(' ', s, p, o, e) AS line FROM (SELECT k.*, CASE WHEN x.s IS NULL THEN 'derived' ELSE 'stated' END AS e FROM k LEFT JOIN t x ON x.s = k.s AND x.p = k.p AND x.o = k.o)",
    )
)
def list_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, names = d.compress(spark, g.run(spark, sf_dir, g.CORE))
    rules = rulefile.rdfs()
    table = c.closure(encoded, rules.mapped(d.ids_of(names, list(rules.constants()))))
    how = F.when(F.col("is_explicit"), "stated").otherwise("derived")
    return d.decode(table.select(*SPO, how.alias("how")), names).select(F.concat_ws(" ", *SPO, "how").alias("line"))


# ---- files and the stored knowledge base ------------------------------------------------------


@query(f"SELECT s, p, o FROM {rows_of(NT)}")
def nt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text triples written as gzipped lines and read back by a file name pattern."""
    path = fresh_path(spark, "nt")
    ntriples.write(graph(spark, sf_dir, NT), path, "gzip")
    return ntriples.read(spark, path, pattern="*.gz")


@query(f"SELECT s, p, o, step, cnt, true AS is_explicit FROM ({duck(COUNTED_IDS)})")
def triple_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted triples of ids written and read back."""
    path = fresh_path(spark, "triples")
    tables.write_triples(g.run(spark, sf_dir, COUNTED_IDS), path)
    return tables.read_triples(spark, path)


def stored_kb(spark: SparkSession, sf_dir: str, sql: str, by_subject: bool = False) -> KnowledgeBase:
    kb = KnowledgeBase(spark, fresh_path(spark, "kb"), by_subject)
    kb.load(g.run(spark, sf_dir, sql))
    return kb


@query(f"SELECT s, p, o FROM {rows_of(g.CORE)}")
def kb_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one knowledge base, read back as text."""
    kb = stored_kb(spark, sf_dir, g.CUSTOMERS + " UNION ALL " + g.SUPPLIERS)
    kb.load(g.run(spark, sf_dir, g.CORE))
    return kb.decoded(kb.triples().select(*SPO))


EXPLICIT = "SELECT k.s, k.p, k.o, x.s IS NOT NULL AS is_explicit FROM k LEFT JOIN t x ON x.s = k.s AND x.p = k.p AND x.o = k.o"


def with_flag(kb: KnowledgeBase) -> DataFrame:
    return kb.decoded(kb.triples().select(*SPO, "is_explicit"))


@query(rdfs_sql(g.CORE, EXPLICIT))
def kb_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions to a stored and materialised knowledge base, as a layer of their own."""
    kb = stored_kb(spark, sf_dir, REST)
    kb.materialise(rulefile.rdfs())
    kb.add(graph(spark, sf_dir, DELTA), rulefile.rdfs())
    return with_flag(kb)


@query(rdfs_sql(REST, EXPLICIT))
def kb_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by deletion and re-derivation."""
    kb = stored_kb(spark, sf_dir, g.CORE)
    kb.materialise(rulefile.rdfs())
    kb.remove(graph(spark, sf_dir, DELTA), rulefile.rdfs())
    return with_flag(kb)


@query(rdfs_sql(REST, COUNTS))
def kb_remove_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = stored_kb(spark, sf_dir, g.CORE)
    kb.materialise(rulefile.rdfs(), counting=True)
    kb.remove(graph(spark, sf_dir, DELTA), rulefile.rdfs(), by_counts=True)
    return kb.decoded(kb.triples().select(*SPO, "cnt"))


#: Facts that the closure derives, stated later.
RESTATED = f"SELECT {g.node('customer', 'c_custkey')} AS s, '{TYPE}' AS p, '<{g.EX}class/Agent>' AS o FROM {{customer}}"


@query(rdfs_sql(g.CORE, f"SELECT k.s, k.p, k.o, x.s IS NOT NULL OR y.s IS NOT NULL AS is_explicit FROM k LEFT JOIN t x ON x.s = k.s AND x.p = k.p AND x.o = k.o LEFT JOIN {rows_of(RESTATED)} y ON y.s = k.s AND y.p = k.p AND y.o = k.o"))
def kb_restate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of facts that were derived before: they are stated from then on."""
    kb = stored_kb(spark, sf_dir, g.CORE)
    kb.materialise(rulefile.rdfs())
    kb.load(g.run(spark, sf_dir, RESTATED))
    return with_flag(kb)


@query(f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE s IN ('<{g.EX}customer/3>', '<{g.EX}customer/7>')")
def kb_query_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by subject in the layout that has subjects in ranges."""
    kb = stored_kb(spark, sf_dir, g.CORE, by_subject=True)
    ids = d.ids_of(kb.dictionary(), [f"<{g.EX}customer/3>", f"<{g.EX}customer/7>"])
    found = [kb.query(s=i).select(*SPO) for i in ids.values()]
    return kb.decoded(c.union_all(found)) if found else kb.decoded(kb.triples().select(*SPO).limit(0))


@query(rdfs_sql(g.CORE))
def delta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update that comes as a file of ids."""
    kb = stored_kb(spark, sf_dir, g.CORE)
    path = fresh_path(spark, "delta")
    # the update is a part of the graph, taken out first
    part = d.encode(graph(spark, sf_dir, DELTA), kb.dictionary())
    tables.write_triples(part, path)
    kb.materialise(rulefile.rdfs())
    kb.remove(tables.read_delta(spark, path, 0).select(*SPO), rulefile.rdfs())
    kb.add(tables.read_delta(spark, path, 0).select(*SPO), rulefile.rdfs())
    return kb.decoded(kb.triples().select(*SPO))


ASKED_TERMS = (
    "SELECT concat('<http://ex/nation/', n_nationkey, '>') AS term, 'O' AS pos FROM {nation}"
    f" UNION ALL SELECT '<{g.EX}inRegion>', 'P' FROM {{region}} WHERE r_regionkey = 0 UNION ALL SELECT '<{g.EX}nothing>', 'S' FROM {{region}}"
)


@query(
    f"SELECT s, p, o FROM {rows_of(g.CORE)} WHERE p = '<{g.EX}inRegion>' OR o IN (SELECT concat('<http://ex/nation/', n_nationkey, '>') FROM nation)"
)
def lookup_and_pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from a file become patterns in a file, whose answers are appended to a file of ids and decoded."""
    kb = stored_kb(spark, sf_dir, g.CORE)
    asked, patterns, answers = (fresh_path(spark, x) for x in ("asked", "patterns", "answers"))
    g.run(spark, sf_dir, ASKED_TERMS).select(F.concat_ws("\t", "term", "pos")).write.text(asked)
    d.lookup(kb.dictionary(), tables.read_lookups(spark, asked)).select("query").write.text(patterns)
    found = t.answer_patterns(kb.triples().select(*SPO), tables.read_patterns(spark, patterns))
    tables.append_answers(found.select(*SPO), answers)
    return kb.decoded(tables.read_number_text(spark, answers)).distinct()

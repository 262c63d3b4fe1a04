"""Registered queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from ruleloom import graphs
from ruleloom.operators import triples
from ruleloom.plans import closure
from ruleloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Fixpoints and stored knowledge bases over the whole graph take tens of seconds each in local mode; test_rules and
#: test_sources cover what they do on small graphs, and the driver compares all of them with their SQL.
SLOW = {
    "derivations_per_rule", "incr_add", "incr_add_counts", "incr_remove_dred", "incr_remove_dred_counts", "incr_readd", "list_kb",
    "rdfs_closure_counts", "kb_add", "kb_remove", "kb_remove_counting", "delta_files",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL and n not in SLOW])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(ORACLE_SQL[name]).columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = sorted(map(tuple, duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)


def test_one_pass_reads_triples_once(spark, tmp_path):
    """One scan of the triples beside those that collect the schema, and one shuffle of what follows."""
    path = str(tmp_path / "triples")
    graphs.run(spark, SF, graphs.CORE).write.parquet(path)
    plan = closure.rdfs_closure(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    scans = [x for x in plan.splitlines() if "Relation" in x and "s#" in x and "p#" in x and "o#" in x]
    assert len(scans) == 1, plan


def test_patterns_read_triples_once(spark):
    rows = spark.createDataFrame([("a", "b", "c")], "s string, p string, o string").repartition(1)
    asked = spark.createDataFrame([(1, "-1", "b", "-1"), (2, "a", "-1", "-1"), (3, "-1", "-1", "-1")], "qid int, s string, p string, o string")
    plan = triples.answer_patterns(rows, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Repartition") == 1

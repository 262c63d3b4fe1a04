"""Large graphs in buckets: the same results, from one read of the input for the triples and none for each pass."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from ruleloom import graphs, queries
from ruleloom.functions.terms import TYPE
from ruleloom.operators import bulk
from ruleloom.sources import lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _odd(spark):
    rows = [(f"<s{k % 90}>", f"<p{k % 4}>", f"<o{k % 37}>" if k % 3 else "<hot>") for k in range(700)]
    rows += [("<s1>", TYPE, "<hot>"), ("<hot>", "<p1>", "<s2>"), ("<hot>", "<hot>", "<hot>"), ("<s2>", "<p1>", "<s1>"), ("<p1>", "<p2>", "<p3>")]
    rows += [(None, "<p1>", "<o1>"), ("<s1>", None, "<o1>"), ("<s1>", "<p1>", None), (None, None, None), ("", "", ""), ("<é>", "<p1>", '"1\\n"@en')]
    return spark.createDataFrame(rows + rows[:50], "s string, p string, o string")


@pytest.mark.parametrize("threshold", [None, 100])
def test_terms_of_every_kind(spark, monkeypatch, threshold):
    monkeypatch.setattr(bulk, "MOST_BUCKETS", 5)
    triples = _odd(spark)
    coded = bulk.compress(spark, triples, threshold)
    want = sorted(map(tuple, triples.distinct().collect()), key=repr)
    names = {r["id"]: r["term"] for r in coded.near.unionByName(coded.names).collect()}
    assert len(names) == len(set(names.values())) == coded.near.count() + coded.names.count()
    ids = [tuple(r) for r in coded.triples.collect()]
    assert sorted([tuple(names.get(x) for x in r) for r in ids], key=repr) == want
    popular = {names[k] for k in names if 100 <= k < 200}
    assert popular == ({"<hot>", "<p0>", "<p1>", "<p2>", "<p3>"} if threshold else set())
    assert sorted(map(tuple, bulk.decode(coded).select("s", "p", "o").collect()), key=repr) == want


def test_joins_of_buckets_do_not_shuffle(spark):
    rows = spark.range(1000).selectExpr("id", "id % 10 as k")
    a, b = lineage.dealt([rows], "id", 4, "test"), lineage.dealt([rows.filter("k < 5"), rows.filter("k >= 5")], "id", 4, "test")
    both = a.distinct().join(b.hint("shuffle_hash").withColumnRenamed("k", "j"), "id", "left")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.filter("j is null").count() == 0
    assert both.count() == 1000
    name = os.path.basename(os.path.dirname(a.inputFiles()[0])).replace("-", "_")
    lineage.removed(a)
    assert not spark.catalog.tableExists(name)


def test_edges_read_together(spark):
    rows = lambda sql: sorted(map(tuple, graphs.run(spark, SF, sql).select("s", "p", "o").collect()))
    assert rows(graphs.once(graphs.FULL)) == rows(graphs.FULL)
    assert graphs.once(graphs.FULL).count("{lineitem}") == 1


@pytest.mark.parametrize("name", ["decode_roundtrip", "rdfs_closure_one_pass"])
def test_large_graph_is_read_once(spark, duck, monkeypatch, name):
    """Before, each pass read all tables again."""
    reads = []
    stored = lineage.written_parts
    monkeypatch.setattr(lineage, "PASS_BYTES", 90_000)
    monkeypatch.setattr(queries.d, "written_parts", lambda parts, label: reads.append(len(parts)) or stored(parts, label))
    got = queries.QUERIES[name](spark, SF).select("s", "p", "o").collect()
    assert not [n for n in reads if n > 1]
    assert sorted(map(tuple, got)) == sorted(duck.sql(f"SELECT s, p, o FROM ({queries.ORACLE_SQL[name]})").fetchall())

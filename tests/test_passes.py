"""Large graphs in passes: the same results, and little left on disk."""

from __future__ import annotations

import glob
import os
import time

import duckdb

from ruleloom import queries
from ruleloom.functions.terms import TYPE
from ruleloom.operators import dictionary
from ruleloom.sources import lineage

SF = "/root/testdata/sf0.001"


def _terms_of_every_kind(spark):
    rows = [(f"<s{k % 90}>", f"<p{k % 4}>", f"<o{k % 37}>" if k % 3 else "<hot>") for k in range(700)]
    rows += [("<s1>", TYPE, "<hot>"), ("<hot>", "<p1>", "<s2>"), ("<hot>", "<hot>", "<hot>")]
    return spark.createDataFrame(rows + rows[:50], "s string, p string, o string")


def test_passes_give_what_one_shuffle_gives(spark, monkeypatch):
    triples = _terms_of_every_kind(spark)
    want = sorted(triples.distinct().collect())
    one, one_names = dictionary.compress(spark, triples, threshold=100)
    one, one_names = sorted(one.collect()), sorted(one_names.collect())
    monkeypatch.setattr(lineage, "PASS_BYTES", lineage.planned_bytes(triples) // 3)
    assert lineage.passes_for(triples) > 2
    ids, names = dictionary.compress(spark, triples, threshold=100)
    assert sorted(ids.collect()) == one and sorted(names.collect()) == one_names
    assert sorted(dictionary.decode(ids, names, passes=3).select("s", "p", "o").collect()) == want
    # what a dictionary lacks and null
    odd = spark.createDataFrame([("<s1>", None, "<new>"), (None, "<p1>", "<hot>")], "s string, p string, o string")
    assert sorted(map(repr, dictionary.encode(odd, names, 3).collect())) == sorted(map(repr, dictionary.encode(odd, names).collect()))


def test_written_leaves_no_shuffle_files(spark):
    """A shuffle's files go when what it was for is stored, not with the driver's garbage."""
    before = spark.conf.get(lineage.SHUFFLES_DROPPED, None)
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    time.sleep(2)
    had = blocks()
    table = lineage.written(spark.range(1000).repartition(7, "id"), "test")
    for _ in range(50):
        if blocks() <= had:
            break
        time.sleep(0.1)
    assert blocks() <= had and table.count() == 1000 and spark.conf.get(lineage.SHUFFLES_DROPPED, None) == before


def test_stored_steps_go(spark, tmp_path, monkeypatch):
    triples = _terms_of_every_kind(spark)
    monkeypatch.setattr(lineage, "PASS_BYTES", lineage.planned_bytes(triples) // 3)
    monkeypatch.setattr(lineage, "shared_root", lambda _: f"file://{tmp_path}")
    ids, names = dictionary.compress(spark, triples)
    left = {x.name.split("-")[1] for x in tmp_path.iterdir()}
    assert not left & {"text", "terms"} and sum("looked" in x.name for x in tmp_path.iterdir()) == 1
    assert ids.count() == triples.distinct().count() and names.count() > 42


def test_one_pass_closure_in_passes(spark, monkeypatch):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    monkeypatch.setattr(lineage, "PASS_BYTES", 90_000)
    got = queries.rdfs_closure_one_pass(spark, SF).select("s", "p", "o").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT s, p, o FROM ({queries.ORACLE_SQL['rdfs_closure_one_pass']})").fetchall())

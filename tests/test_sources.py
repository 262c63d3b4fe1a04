from __future__ import annotations

import gzip

from ruleloom import cli
from ruleloom.functions import terms
from ruleloom.model import SPO, TEXT_TRIPLE
from ruleloom.operators import dictionary as d
from ruleloom.operators import triples as t
from ruleloom.plans import store
from ruleloom.plans.store import KnowledgeBase
from ruleloom.sources import ntriples, rulefile, tables
from ruleloom.streaming import updates

NT = """<http://ex/s> <http://ex/p> <http://ex/o> .
# a comment

_:b1 <http://ex/p> "a \\"q\\" b"@en .
<http://ex/s> <http://ex/p> "1"^^<http://ex/t> .
  <http://ex/s>\t<http://ex/p>   _:b1.
<http://ex/s> <http://ex/p> <http://ex/o> .
<http://ex/s> <http://ex/p> "unclosed .
<http://ex/s> <http://ex/p>
"""


def test_parse(spark, tmp_path):
    (tmp_path / "a.nt").write_text(NT)
    (tmp_path / "b.txt").write_text("not a triple\n")
    lines = ntriples.parse(ntriples.read_lines(spark, str(tmp_path), "*.nt"))
    assert tuple(ntriples.counts(lines).first()) == (5, 2)
    rows = {tuple(r) for r in lines.filter("ok").select(*SPO).collect()}
    assert ("_:b1", "<http://ex/p>", '"a \\"q\\" b"@en') in rows and ("<http://ex/s>", "<http://ex/p>", "_:b1") in rows
    renamed = ntriples.read(spark, str(tmp_path), rename_bnodes=True, pattern="*.nt")
    assert renamed.filter("s like '\\\\_:%ant1' or s like '\\\\_:%b1'").count() == 1
    with gzip.open(tmp_path / "c.nt.gz", "wt") as f:
        f.write(NT)
    assert ntriples.read(spark, str(tmp_path / "c.nt.gz")).count() == 5


def test_long_literal(spark):
    text = '"' + "x\\n" * 50_000 + '"@en'
    rows = spark.createDataFrame([(f"<s> <p> {text} .",)], "value string")
    row = ntriples.parse(rows).select("ok", "o", terms.language(ntriples.F.col("o")).alias("l")).first()
    assert row["ok"] and row["o"] == text and row["l"] == "en"


def test_dictionary(spark):
    rows = spark.createDataFrame([("b", "p", "a"), ("é", terms.TYPE, "Z"), ("b", "p", "a")], TEXT_TRIPLE)
    names = d.build(rows)
    got = {r["term"]: r["id"] for r in names.collect()}
    order = sorted(["a", "b", "p", "Z", "é"], key=str.encode)
    assert [got[x] for x in order] == [200, 201, 202, 203, 204] and got[terms.TYPE] == 0 and len(got) == 47
    more = {r["term"]: r["id"] for r in d.build(spark.createDataFrame([("b", "q", "0")], TEXT_TRIPLE), names).collect()}
    assert more["b"] == got["b"] and more["0"] == 205 and more["q"] == 206
    encoded = d.encode(rows, names)
    assert encoded.filter("s is null or p is null or o is null").isEmpty()
    assert sorted(map(tuple, d.decode(encoded, names).collect())) == sorted(map(tuple, rows.collect()))
    unknown = d.encode(spark.createDataFrame([("zz", "p", "a")], TEXT_TRIPLE), names)
    assert unknown.first()["s"] is None


def test_popular(spark):
    rows = spark.createDataFrame([(f"s{k}", "p", "o" if k % 2 else "u") for k in range(10)], TEXT_TRIPLE)
    assert [(r["id"], r["term"], r["n"]) for r in d.popular_terms(rows, 4).orderBy("id").collect()] == [(100, "p", 10), (101, "o", 5), (102, "u", 5)]
    many = spark.createDataFrame([(f"s{k}", "p", f"o{k}") for k in range(150) for _ in range(2)], TEXT_TRIPLE)
    assert d.popular_terms(many, 1).count() == 100


def test_operators(spark):
    rows = spark.createDataFrame([(1, 2, 3, 0, 1), (1, 2, 3, 2, 4), (3, 2, 1, 5, 1)], "s bigint, p bigint, o bigint, step int, cnt bigint")
    assert sorted(map(tuple, t.sum_counts(rows).collect())) == [(1, 2, 3, 0, 5), (3, 2, 1, 5, 1)]
    assert t.permute(rows).count() == 18 and {r[0] for r in t.permute(rows).select("perm").collect()} == set(range(6))
    assert {r["line"] for r in t.dump(spark, rows).collect()} == {"Property range domain 0", "Property range domain 2", "domain range Property 5"}
    asked = spark.createDataFrame([(1, 1, -1, -1), (2, -1, -1, -1), (3, -1, 2, 1), (4, 9, 9, 9)], "qid int, s bigint, p bigint, o bigint")
    got = t.answer_patterns(rows.select(*SPO).distinct(), asked)
    assert sorted((r["qid"], r["s"]) for r in got.collect()) == [(1, 1), (2, 1), (2, 3), (3, 3)]


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), by_subject=True)
    facts = [("<A>", terms.SUBCLASS, "<B>"), ("<x>", terms.TYPE, "<A>"), ("<y>", "<p>", "<z>")]
    kb.load(spark.createDataFrame(facts, TEXT_TRIPLE))
    rules = rulefile.rdfs()
    kb.materialise(rules, counting=True)
    text = lambda: {tuple(r) for r in kb.decoded(kb.triples().select(*SPO)).collect()}
    assert text() == {*facts, ("<x>", terms.TYPE, "<B>")}
    more = [("<p>", terms.DOMAIN, "<A>"), ("<new>", "<p>", "<z>")]
    kb.add(spark.createDataFrame(more, TEXT_TRIPLE), rules)
    assert ("<new>", terms.TYPE, "<B>") in text() and len(text()) == 10
    made = kb.meta["made"]
    kb.remove(spark.createDataFrame(more, TEXT_TRIPLE), rules, by_counts=True)
    assert text() == {*facts, ("<x>", terms.TYPE, "<B>")} and kb.meta["made"] == made + 1
    ids = d.ids_of(kb.dictionary(), ["<x>"])
    assert kb.query(s=ids["<x>"]).count() == 2 and kb.query(p=0).count() == 2
    assert kb.permutations().count() == 24 and kb.listing().count() == 4
    kb.vacuum()
    assert len(text()) == 4


def test_store_keeps_what_was_stated(spark, tmp_path):
    kb, rules = KnowledgeBase(spark, str(tmp_path / "kb"), by_subject=True), rulefile.rdfs()
    kb.load(spark.createDataFrame([("<A>", terms.SUBCLASS, "<B>"), ("<x>", terms.TYPE, "<A>")], TEXT_TRIPLE))
    kb.materialise(rules, counting=True)
    derived = spark.createDataFrame([("<x>", terms.TYPE, "<B>")], TEXT_TRIPLE)
    kb.load(derived)
    row = kb.triples().join(d.encode(derived, kb.dictionary()), SPO).first()
    assert row["is_explicit"] and row["cnt"] == 2 and kb.report()["restated"] == 1
    kb.remove(spark.createDataFrame([("<A>", terms.SUBCLASS, "<B>")], TEXT_TRIPLE), rules)
    assert {tuple(r) for r in kb.decoded(kb.triples().select(*SPO)).collect()} == {("<x>", terms.TYPE, "<A>"), ("<x>", terms.TYPE, "<B>")}
    # another handle, not told of the subject layout, keeps it
    other = KnowledgeBase(spark, str(tmp_path / "kb"))
    other.add(spark.createDataFrame([("<y>", terms.TYPE, "<A>")], TEXT_TRIPLE), rules)
    ids = d.ids_of(other.dictionary(), ["<x>", "<y>"])
    assert other.query(s=ids["<x>"]).count() == 2 and other.query(s=ids["<y>"]).count() == 1
    assert len(other.meta["layers"]) > 1
    before = as_rows(other)
    other.compact()
    assert len(other.meta["layers"]) == 1 and as_rows(other) == before


def as_rows(kb):
    return sorted(map(tuple, kb.triples().select(*SPO, "cnt", "is_explicit").collect()))


def test_store_after_a_crash(spark, tmp_path, monkeypatch):
    kb, rules = KnowledgeBase(spark, str(tmp_path / "kb")), rulefile.rdfs()
    kb.load(spark.createDataFrame([("<x>", terms.TYPE, "<A>")], TEXT_TRIPLE))
    before, stale = as_rows(kb), kb.meta

    def crash(self, meta):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KnowledgeBase, "_point", crash)
        for change in (lambda: kb.load(spark.createDataFrame([("<x>", terms.TYPE, "<B>")], TEXT_TRIPLE)), lambda: kb.materialise(rules)):
            try:
                change()
            except OSError:
                pass
    again = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert again.exists() and as_rows(again) == before
    again.load(spark.createDataFrame([("<x>", terms.TYPE, "<B>")], TEXT_TRIPLE))
    again.vacuum()
    assert len(as_rows(again)) == 2
    try:
        again._point(stale)
        raise AssertionError("two writers")
    except RuntimeError:
        pass
    monkeypatch.setattr(store, "MOST_LAYERS", 3)
    sizes = []
    for k in range(3):
        again.load(spark.createDataFrame([("<x>", terms.TYPE, f"<C{k}>")], TEXT_TRIPLE))
        sizes.append(len(again.meta["layers"]))
    assert len(as_rows(again)) == 5 and sizes == [3, 1, 2]


def test_popular_terms_do_not_shuffle(spark):
    rows = spark.createDataFrame([(f"<s{k}>", terms.TYPE, "<Hot>" if k % 9 else f"<o{k}>") for k in range(500)] + [(None, "<p>", "<o>")], TEXT_TRIPLE)
    names = d.build(rows, threshold=50, fraction=0.5)
    assert {r["term"]: r["id"] for r in names.collect()}["<Hot>"] == 100
    encoded = d.encode(rows, names)
    assert encoded.count() == 501 and encoded.filter("o is null").isEmpty() and encoded.filter("s is null").count() == 1
    plain = d.build(rows)
    ids = d.encode(rows, plain)
    hot = d.ids_of(plain, ["<Hot>"])["<Hot>"]
    assert hot in {r["id"] for r in d.popular_ids(ids, 50, 0.5).collect()}
    back = d.decode(ids, plain, threshold=50, fraction=0.5)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text(f"<x> {terms.TYPE} <A> .\nbroken\n<A> {terms.SUBCLASS} <B> .\n")
    kb, rules = KnowledgeBase(spark, str(tmp_path / "kb")), rulefile.rdfs()
    lines = lambda: updates.triples(spark.readStream.text(str(tmp_path / "in")))
    updates.maintain(lines(), kb, rules, str(tmp_path / "cp")).awaitTermination()
    assert kb.triples().count() == 3
    (tmp_path / "in" / "b.nt").write_text(f"<y> {terms.TYPE} <A> .\n<x> {terms.TYPE} <A> .\n")
    updates.maintain(lines(), kb, rules, str(tmp_path / "cp")).awaitTermination()
    assert kb.triples().count() == 5


def test_command_line(spark, tmp_path):
    (tmp_path / "a.nt").write_text(f"<x> {terms.TYPE} <A> .\n<A> {terms.SUBCLASS} <B> .\n")
    at = lambda x: str(tmp_path / x)
    go = lambda *a: cli.main(list(a), spark)
    go("compress", at("a.nt"), at("kb"))
    go("reason", at("kb"), "--counts", "--debug-file", at("debug"))
    (tmp_path / "q").write_text("-1 0 -1\n-1 -1 -1\n")
    go("query", at("kb"), at("q"), at("answers"))
    assert spark.read.text(at("answers")).count() == 5
    go("decompress", at("kb"), at("out"))
    assert spark.read.text(at("out")).count() == 3
    (tmp_path / "l").write_text("<B>\tO\nnone\tS\n")
    go("lookup", at("kb"), at("l"), at("looked"))
    assert spark.read.text(at("looked")).first()[0].startswith("-1 -1 2")
    go("index", at("kb"), at("perm"), "--permutations")
    assert spark.read.parquet(at("perm")).count() == 18
    go("list", at("kb"), at("list"))
    go("dictionary", at("kb"), at("dict"))
    (tmp_path / "b.nt").write_text("<z> <p> <q> .\n")
    go("reason", at("kb"), "--add", at("b.nt"))
    go("reason", at("kb"), "--remove", at("b.nt"), "--by-counts")
    go("sort", at("a.nt"), at("sorted"), "--full")
    assert KnowledgeBase(spark, at("kb")).triples().count() == 3


def test_files(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3), (1, 2, 3)], "s bigint, p bigint, o bigint").write.parquet(str(tmp_path / "t"))
    stored = tables.read_triples(spark, str(tmp_path / "t"))
    assert stored.first().asDict() == {"s": 1, "p": 2, "o": 3, "step": 0, "cnt": 1, "is_explicit": True}
    assert tables.read_delta(spark, str(tmp_path / "t"), 4).collect()[0]["step"] == 4
    (tmp_path / "n.txt").write_text("1 2 3\n4 5 6\n")
    assert tables.read_number_text(spark, str(tmp_path / "n.txt")).count() == 2
    terms.standard_terms(spark).write.parquet(str(tmp_path / "d"))
    assert tables.read_dictionary(spark, str(tmp_path / "d"), below=10).count() == 10

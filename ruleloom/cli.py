"""Command line: compress, index, reason, query, decompress, list, lookup, dictionary, sort and storage."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.terms import SCHEMA_PREDICATES
from .model import SPO
from .operators import dictionary as dictionary_ops
from .operators.triples import answer_patterns, dump, permute, sort_distinct, sum_counts
from .plans.store import KnowledgeBase
from .sources import ntriples, rulefile, tables


def rules_from(path: str | None):
    return rulefile.rdfs() if path in (None, "rdfs") else rulefile.read_rules(path)


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    kb = KnowledgeBase(spark, a.kb)
    lines = ntriples.parse(ntriples.read_lines(spark, a.input, a.filter))
    watched, seen = ntriples.observed(lines, a.rename_bnodes)
    kb.load(watched, a.popular, a.sample)
    print(f"triples: {seen.get['parsed']}, malformed lines: {seen.get['malformed']}")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """A knowledge base, or its schema alone, or its six permutations, as files elsewhere."""
    kb = KnowledgeBase(spark, a.kb)
    if a.save_dictionary:
        kb.dictionary().write.parquet(a.save_dictionary)
    table = kb.triples()
    if a.copy_only_schema:
        ids = dictionary_ops.ids_of(kb.dictionary(), SCHEMA_PREDICATES)
        table = table.filter(F.col("p").isin(list(ids.values())))
    if a.counts:
        table = sum_counts(table)
    if a.permutations:
        permute(table).write.partitionBy("perm").parquet(a.output)
    else:
        tables.write_triples(table, a.output)


def reason(spark: SparkSession, a: argparse.Namespace) -> None:
    kb, rules = KnowledgeBase(spark, a.kb), rules_from(a.rules)
    read = lambda path: tables.read_delta(spark, path, 0).select(*SPO) if a.encoded else ntriples.read(spark, path)
    if a.add:
        kb.add(read(a.add), rules)
    elif a.remove:
        kb.remove(read(a.remove), rules, a.by_counts)
    else:
        kb.materialise(rules, a.counts)
    print(", ".join(f"{k}: {v}" for k, v in kb.report().items()))
    if a.write_copy:
        kb.copy(a.write_copy, SCHEMA_PREDICATES if a.copy_only_schema else None)
    if a.debug_file:
        dump(spark, kb.triples(), a.debug_file)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    kb = KnowledgeBase(spark, a.kb)
    found = answer_patterns(kb.triples().select(*SPO), tables.read_patterns(spark, a.queries))
    tables.append_answers(found.select(*SPO), a.output)


def decompress(spark: SparkSession, a: argparse.Namespace) -> None:
    kb = KnowledgeBase(spark, a.kb)
    ntriples.write(kb.decoded(kb.triples().select(*SPO), a.popular, a.sample), a.output, a.compression)


def list_kb(spark: SparkSession, a: argparse.Namespace) -> None:
    KnowledgeBase(spark, a.kb).listing().write.text(a.output)


def lookup(spark: SparkSession, a: argparse.Namespace) -> None:
    found = dictionary_ops.lookup(KnowledgeBase(spark, a.kb).dictionary(), tables.read_lookups(spark, a.input))
    found.select("query").write.text(a.output)


def dictionary(spark: SparkSession, a: argparse.Namespace) -> None:
    names = KnowledgeBase(spark, a.kb).dictionary()
    names.select(F.concat_ws("\t", F.col("id").cast("string"), "term")).write.text(a.output)


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = ntriples.read_lines(spark, a.input)
    (sort_distinct(lines) if a.full else lines.select("value").distinct()).write.text(a.output)


def storage(spark: SparkSession, a: argparse.Namespace) -> None:
    """Time to write and read back a number of sequential keys."""
    start = time.perf_counter()
    spark.range(a.records).write.parquet(a.output)
    written = time.perf_counter()
    spark.read.parquet(a.output).agg(F.sum("id")).collect()
    million = a.records / 1e6
    print(f"seconds a million records: written {(written - start) / million:.3f}, read {(time.perf_counter() - written) / million:.3f}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ruleloom", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(f, name: str, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=f.__doc__)
        for x in arguments:
            p.add_argument(x)
        p.set_defaults(run=f)
        return p

    p = command(compress, "compress", "input", "kb")
    p.add_argument("--popular", type=int, help="terms that occur more often than this get low ids")
    p.add_argument("--sample", type=float, default=1.0, help="share of the triples in which they are counted")
    p.add_argument("--rename-bnodes", action="store_true")
    p.add_argument("--filter", help="file name glob")
    p = command(index, "index", "kb", "output")
    p.add_argument("--copy-only-schema", action="store_true")
    p.add_argument("--counts", action="store_true")
    p.add_argument("--permutations", action="store_true")
    p.add_argument("--save-dictionary", help="a folder for the dictionary")
    p = command(reason, "reason", "kb")
    p.add_argument("--rules", help="a rule file; the RDFS rules without one")
    p.add_argument("--add")
    p.add_argument("--remove")
    p.add_argument("--by-counts", action="store_true")
    p.add_argument("--counts", action="store_true")
    p.add_argument("--encoded", action="store_true", help="updates are files of ids")
    p.add_argument("--debug-file")
    p.add_argument("--write-copy", help="a folder for a copy of the result")
    p.add_argument("--copy-only-schema", action="store_true")
    command(query, "query", "kb", "queries", "output")
    p = command(decompress, "decompress", "kb", "output")
    p.add_argument("--compression", default="none", choices=["none", "gzip"])
    p.add_argument("--popular", type=int, help="ids that occur at least as often are looked up apart")
    p.add_argument("--sample", type=float, default=1.0, help="share of the triples in which they are counted")
    command(list_kb, "list", "kb", "output")
    command(lookup, "lookup", "kb", "input", "output")
    command(dictionary, "dictionary", "kb", "output")
    p = command(sort, "sort", "input", "output")
    p.add_argument("--full", action="store_true")
    p = command(storage, "storage", "output")
    p.add_argument("--records", type=int, default=100_000_000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ruleloom").getOrCreate()
    arguments.run(spark, arguments)


if __name__ == "__main__":
    main()

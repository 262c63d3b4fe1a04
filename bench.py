"""Times the headline queries once each over $BENCH_SF_DIR and prints one JSON line.

three runs, with the triples that go in and come out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ruleloom import graphs as g
from ruleloom.functions import terms
from ruleloom.model import SPO
from ruleloom.operators import dictionary as d
from ruleloom.operators import triples as t
from ruleloom.plans import closure as c
from ruleloom.plans import incremental as inc
from ruleloom.queries import QUERIES
from ruleloom.sources import rulefile
from ruleloom.sources.lineage import written

#: Encoding and decoding, sorting, closures, patterns and maintenance.
HEADLINE = [
    "sort_distinct", "decode_roundtrip", "pattern_p", "pattern_batch", "permute_six", "rdfs_closure", "rdfs_closure_one_pass",
    "rdfs_closure_counts", "deep_taxonomy", "incr_add", "incr_remove_dred", "incr_remove_counting",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ruleloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def baseline(spark: SparkSession, sf_dir: str) -> dict[str, dict]:
    """B1 to B8: {name: seconds, triples in, triples out}."""
    ready = lambda df, label: written(df, label)
    text = ready(g.run(spark, sf_dir, g.FULL).distinct(), "text")
    core = ready(d.compress(spark, g.run(spark, sf_dir, g.CORE))[0], "core")
    names = ready(d.build(g.run(spark, sf_dir, g.CORE)), "names")
    rules = rulefile.rdfs()
    ids = d.ids_of(names, list(rules.constants()))
    rules = rules.mapped(ids)
    edges = ready(g.run(spark, sf_dir, g.TAXONOMY).select("s", "o"), "taxonomy")
    table = ready(c.closure(core, rules, counting=True), "table")
    # 1 % of the instance facts, and an edge of the class hierarchy
    schema = [ids[x] for x in terms.SCHEMA_PREDICATES if x in ids]
    facts = ready(t.sampled(core.filter(~F.col("p").isin(schema)), 0.01), "facts")
    edge = ready(core.filter(F.col("p") == F.lit(ids[terms.SUBCLASS])).orderBy("s", "o").limit(1), "edge")
    less = {x: ready(c.closure(t.difference(core, df), rules), "less") for x, df in (("facts", facts), ("edge", edge))}

    def change(made):
        """All that a change puts and takes away."""

        def run():
            found = made()
            return found.rows.select(*SPO).unionByName(found.gone.select(*SPO))

        return run

    work = {
        "B1 encode and decode": (text, lambda: d.decode(*d.compress(spark, text))),
        "B2 closure, rounds": (core, lambda: c.closure(core, rules)),
        "B2 closure, one pass": (core, lambda: c.rdfs_closure(core, ids)),
        "B3 closure with counts": (core, lambda: c.closure(core, rules, counting=True)),
        "B4 deep taxonomy": (edges, lambda: c.reach(edges)),
        "B5 add 1 % of facts": (facts, change(lambda: inc.addition(less["facts"], facts, rules))),
        "B5 add an edge": (edge, change(lambda: inc.addition(less["edge"], edge, rules))),
        "B6 remove 1 % of facts, re-derivation": (facts, change(lambda: inc.removal(table, facts, rules))),
        "B6 remove 1 % of facts, counts": (facts, change(lambda: inc.removal_counting(table, facts, rules))),
        "B6 remove 1 % of facts, recompute": (facts, lambda: c.closure(t.difference(core, facts), rules)),
        "B6 remove an edge, re-derivation": (edge, change(lambda: inc.removal(table, edge, rules))),
        "B6 remove an edge, counts": (edge, change(lambda: inc.removal_counting(table, edge, rules))),
        "B7 eight pattern shapes": (table, lambda: t.answer_patterns(table.select(*SPO), shapes(table))),
        "B8 sort and distinct": (text, lambda: t.sort_distinct(text.select(F.concat_ws(" ", *SPO).alias("value")))),
    }
    out = {}
    for name, (given, run) in work.items():
        times, rows = [], 0
        for _ in range(3):
            start = time.perf_counter()
            rows = run().agg(F.count("*"), F.sum(F.lit(1))).first()[0]
            times.append(time.perf_counter() - start)
        out[name] = {"seconds": round(sorted(times)[1], 3), "in": given.count(), "out": rows}
        print(name, out[name], file=sys.stderr, flush=True)
    return out


def shapes(table):
    """A pattern of each shape, from one triple of the table."""
    s, p, o = table.orderBy(*SPO).select(*SPO).first()
    rows = [(b, s if b & 1 else -1, p if b & 2 else -1, o if b & 4 else -1) for b in range(8)]
    return table.sparkSession.createDataFrame(rows, "qid int, s bigint, p bigint, o bigint")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    if sys.argv[1:] == ["--baseline"]:
        print(json.dumps(baseline(spark, sf_dir)))
        return
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

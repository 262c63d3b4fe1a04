from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from ruleloom.llm import decontaminate, quality
from ruleloom.llm.common import table, written

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(spark, stage(spark, docs, SF), "test")
        steps.append((name, before, docs))
        if name != "bpe":
            assert docs.columns == names
    kept = {name: {r["doc_id"] for r in after.select("doc_id").collect()} for name, _, after in steps}
    start = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    good = {r["doc_id"] for r in quality.verdicts(spark, table(spark, SF, "documents")).filter("kept").collect()}
    assert kept["quality_rules"] == good and all(not brute.quality(start[d])[5] for d in good)
    groups = brute.groups({d: start[d] for d in good}, 5, 80)
    assert kept["near_duplicates"] == {d for d, g in groups.items() if d == g}
    left = table(spark, SF, "documents").filter(F.col("doc_id").isin(list(kept["near_duplicates"])))
    leaked = {r["doc_id"] for r in decontaminate.leaks(spark, left, table(spark, SF, "benchmark")).collect()}
    assert kept["decontamination"] == kept["near_duplicates"] - leaked
    assert kept["secret_scan"] == kept["decontamination"] == kept["bpe"]
    after = next(x for n, _, x in steps if n == "secret_scan")
    assert not any(brute.secrets(r["text"]) for r in after.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(kept["bpe"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, score double"


def test_stages_on_odd_tables(spark):
    prose = " ".join(f"word{k} said" for k in range(40))
    rows = [(None, prose + " one", "en", None, 1, "x", None, 0.5), (1, None, None, "s", None, None, "y", None), (2, "", "en", "s", 0, None, None, 1.0)]
    rows += [(3, prose + " two", "en", "s", 5, "z", "w", None), (3, prose + " two", "en", "s", 5, "z", "w", None), (4, prose + " password: hunter2222", "de", "s", 7, None, None, None)]
    want = {
        "quality_rules": [None, 3, 3, 4], "near_duplicates": [None, 1, 2, 3, 3], "decontamination": [None, 1, 2, 3, 3, 4],
        "secret_scan": [None, 1, 2, 3, 3, 4], "bpe": [None, 1, 2, 3, 3, 4],
    }
    docs = written(spark, spark.createDataFrame(rows, SCHEMA), "odd")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert sorted((r["doc_id"] for r in got.collect()), key=lambda x: (x is not None, x)) == want[name], name
        assert name == "bpe" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0, name

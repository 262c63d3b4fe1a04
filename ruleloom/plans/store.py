"""A knowledge base on disk: layers of triples and dictionary rows, named by a pointer.

A change appends a layer: rows to put, and the triples that leave the layers below. Loading and
materialising write a layer of everything, and so does a change once there are MOST_LAYERS. The
pointer is a file with a number of its own, renamed into place when its layer is complete, so readers
never see half a change, a crash at any point leaves the former pointer as it was, and the second of two
writers that started from one pointer fails. Triples lie in ranges of (p, o, s) with small row groups, so a scan by predicate, or
predicate and object, skips most of them, and a frequent predicate is spread over as many files as
it needs. ``by_subject`` adds a copy in ranges of subject, kept by all later changes.
"""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import standard_terms
from ..model import DICTIONARY, SPO, STORED, TRIPLE, RuleSet
from ..operators import dictionary as dictionary_ops
from ..operators.triples import pattern_scan, permute
from ..sources.lineage import written
from . import closure as closure_plan
from . import incremental

LAYOUTS = {"pos": ["p", "o", "s"], "spo": ["s", "p", "o"]}
#: Layers that a read puts together at most.
MOST_LAYERS = 12
#: Triples that leave lower layers, sent to every executor up to this number.
BROADCAST_GONE = 500_000
POINTER = "CURRENT."


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str, by_subject: bool = False):
        self.spark, self.path, self.by_subject = spark, path.rstrip("/"), by_subject
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- metadata -----------------------------------------------------------------------------

    def _names(self) -> list[str]:
        root = self._jpath(self.path)
        if not self._fs.exists(root):
            return []
        return [PurePosixPath(x.getPath().toString()).name for x in self._fs.listStatus(root)]

    def _pointers(self) -> list[int]:
        return sorted(int(n.removeprefix(POINTER)) for n in self._names() if n.startswith(POINTER) and n.removeprefix(POINTER).isdigit())

    @property
    def meta(self) -> dict:
        """What the newest pointer says: layers, dictionary parts, layouts, last step, whether counts are exact."""
        found = self._pointers()
        if not found:
            return {"pointer": 0, "made": 0, "layers": [], "dictionary": [], "layouts": [], "last_step": 0, "counting": False, "report": {}}
        stream = self._fs.open(self._jpath(f"{self.path}/{POINTER}{found[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, meta: dict) -> None:
        newest = max(self._pointers(), default=0)
        if newest != meta["pointer"]:
            raise RuntimeError(f"{self.path} was changed by another writer")
        meta = meta | {"pointer": newest + 1}
        fresh = self._jpath(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        target = self._jpath(f"{self.path}/{POINTER}{meta['pointer']}")
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"{self.path} was changed by another writer")

    def exists(self) -> bool:
        return bool(self._pointers())

    def last_step(self) -> int:
        return self.meta["last_step"]

    # ---- tables -------------------------------------------------------------------------------

    def triples(self, layout: str = "pos") -> DataFrame:
        out = None
        for layer in self.meta["layers"]:
            rows = self.spark.read.schema(STORED).parquet(f"{self.path}/{layer['name']}/{layout}")
            if out is not None and layer["gone"]:
                gone = self.spark.read.schema(TRIPLE).parquet(f"{self.path}/{layer['name']}/gone")
                out = out.join(F.broadcast(gone) if layer["gone"] <= BROADCAST_GONE else gone, SPO, "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], STORED) if out is None else out

    def dictionary(self) -> DataFrame:
        parts = self.meta["dictionary"]
        if not parts:
            return standard_terms(self.spark)
        return self.spark.read.schema(DICTIONARY).parquet(*[f"{self.path}/{x}" for x in parts])

    def _layer(self, meta: dict, rows: DataFrame) -> dict:
        """Writes the rows as a layer of its own, in the layouts that the knowledge base has."""
        layouts = ["pos"] + ["spo"] * (self.by_subject or "spo" in meta["layouts"])
        if meta["layers"] and layouts != meta["layouts"]:
            raise ValueError("a subject layout starts with a layer of everything")
        name = f"t{meta['made'] + 1}-{uuid.uuid4().hex[:8]}"
        for layout in layouts:
            dealt = rows.repartitionByRange(*LAYOUTS[layout]).sortWithinPartitions(*LAYOUTS[layout])
            dealt.write.option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}/{layout}")
        return {"name": name, "layouts": layouts}

    def write(self, table: DataFrame, counting: bool | None = None, report: dict | None = None) -> None:
        """A layer of everything, instead of all there were."""
        meta = self.meta
        own = self._layer(meta | {"layers": []}, table)
        stored = self.spark.read.schema(STORED).parquet(f"{self.path}/{own['name']}/pos")
        self._point(
            meta
            | {
                "made": meta["made"] + 1, "layers": [{"name": own["name"], "gone": 0}], "layouts": own["layouts"],
                "last_step": incremental.last_step(stored), "counting": meta["counting"] if counting is None else counting,
                "report": report or {},
            }
        )

    def append(self, change: incremental.Change) -> None:
        """A layer of what changed."""
        meta = self.meta
        if change.rows is None:
            return
        if self.by_subject and "spo" not in meta["layouts"] or len(meta["layers"]) >= MOST_LAYERS:
            self.write(incremental.applied(self.triples(), change), report=change.report)
            return
        own = self._layer(meta, change.rows)
        gone = 0
        if change.gone is not None:
            change.gone.select(*SPO).write.parquet(f"{self.path}/{own['name']}/gone")
            gone = self.spark.read.schema(TRIPLE).parquet(f"{self.path}/{own['name']}/gone").count()
        stored = self.spark.read.schema(STORED).parquet(f"{self.path}/{own['name']}/pos")
        self._point(
            meta
            | {
                "made": meta["made"] + 1, "layers": [*meta["layers"], {"name": own["name"], "gone": gone}], "layouts": own["layouts"],
                "last_step": max(meta["last_step"], incremental.last_step(stored)), "report": change.report,
            }
        )

    def compact(self) -> None:
        self.write(self.triples(), report=self.meta["report"])

    def write_dictionary(self, rows: DataFrame, more: bool = False) -> None:
        """A dictionary, or ``more`` rows for it."""
        meta = self.meta
        name = f"d{meta['pointer'] + 1}-{uuid.uuid4().hex[:8]}"
        rows.select("id", "term").write.parquet(f"{self.path}/{name}")
        self._point(meta | {"dictionary": [*(meta["dictionary"] if more else []), name]})

    def vacuum(self) -> None:
        """Deletes what the newest pointer doesn't name; not while others read or write."""
        meta = self.meta
        keep = {x["name"] for x in meta["layers"]} | set(meta["dictionary"]) | {f"{POINTER}{meta['pointer']}"}
        for name in self._names():
            if name not in keep:
                self._fs.delete(self._jpath(f"{self.path}/{name}"), True)

    # ---- operations ---------------------------------------------------------------------------

    def load(self, text: DataFrame, threshold: int | None = None, fraction: float = 1.0) -> None:
        """Text triples, as stated facts beside what is there; a fact that was derived is stated from then on.

        ``threshold`` gives popular terms low ids in a first dictionary, counted over a sample of ``fraction``.
        """
        text = written(text.select(*SPO).distinct(), "text")
        self._grow(text, threshold, fraction)
        encoded = dictionary_ops.encode(text, self.dictionary())
        if self.meta["layers"]:
            self.append(incremental.addition(self.triples(), encoded, RuleSet(), self.meta["counting"], self.last_step()))
        else:
            self.write(closure_plan.explicit(encoded))

    def _grow(self, text: DataFrame, threshold: int | None = None, fraction: float = 1.0) -> None:
        """Ids for the terms that the dictionary lacks."""
        if not self.meta["dictionary"]:
            self.write_dictionary(dictionary_ops.build(text, None, threshold, fraction))
        else:
            self.write_dictionary(dictionary_ops.grown(text, self.dictionary()), more=True)

    def rules_by_id(self, rules: RuleSet) -> RuleSet:
        wanted = [t for t in rules.constants() if isinstance(t, str)]
        return rules.mapped({**dictionary_ops.ids_of(self.dictionary(), wanted), **{t: t for t in rules.constants() if isinstance(t, int)}})

    def materialise(self, rules: RuleSet, counting: bool = False) -> None:
        stated, report = self.triples().filter("is_explicit"), {}
        self.write(closure_plan.closure(stated, self.rules_by_id(rules), counting, report), counting, report)

    def add(self, facts: DataFrame, rules: RuleSet) -> None:
        """Encoded facts; text is encoded first, with new terms where needed."""
        facts = self._encoded(facts)
        self.append(incremental.addition(self.triples(), facts, self.rules_by_id(rules), self.meta["counting"], self.last_step()))

    def remove(self, facts: DataFrame, rules: RuleSet, by_counts: bool = False) -> None:
        counting = self.meta["counting"]
        rules, facts = self.rules_by_id(rules), self._encoded(facts, grow=False)
        if by_counts and not counting:
            raise ValueError("removal by counts needs a knowledge base with counts")
        if by_counts:
            self.append(incremental.removal_counting(self.triples(), facts, rules))
        else:
            self.append(incremental.removal(self.triples(), facts, rules, counting))

    def report(self) -> dict:
        """Counters of the last change: rounds, new, duplicates, restated, removed."""
        return self.meta["report"]

    def _encoded(self, facts: DataFrame, grow: bool = True) -> DataFrame:
        if dict(facts.dtypes)["s"] != "string":
            return facts
        facts = written(facts.select(*SPO).distinct(), "text")
        if grow:
            self._grow(facts)
        return dictionary_ops.encode(facts, self.dictionary()).dropna()

    def query(self, s: int | None = None, p: int | None = None, o: int | None = None) -> DataFrame:
        """Triples that match; a bound subject without a predicate is looked up in the subject layout if there is one."""
        layout = "spo" if s is not None and "spo" in self.meta["layouts"] else "pos"
        return pattern_scan(self.triples(layout), s, p, o)

    def decoded(self, triples: DataFrame, threshold: int | None = None, fraction: float = 1.0) -> DataFrame:
        return dictionary_ops.decode(triples, self.dictionary(), threshold, fraction)

    def permutations(self) -> DataFrame:
        return permute(self.triples())

    def copy(self, path: str, predicates: list[str] | None = None) -> None:
        """The stored rows as files elsewhere, all or those of the given predicates."""
        table = self.triples()
        if predicates is not None:
            table = table.filter(F.col("p").isin(list(dictionary_ops.ids_of(self.dictionary(), predicates).values())))
        table.write.parquet(path)

    def listing(self) -> DataFrame:
        """(line): every triple as text with its step and count."""
        named = self.decoded(self.triples())
        return named.select(F.concat_ws(" ", *SPO, F.col("step").cast("string"), F.col("cnt").cast("string")).alias("line"))

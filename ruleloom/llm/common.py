"""Helpers shared by the corpus operators: table access, shared storage, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folds A-Z only; every other byte (UTF-8 continuation bytes included) stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Entries of each of a memo's two generations, and the longest key that it keeps.
MEMO_ENTRIES, LONGEST_KEPT = 300_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of its own is made only where a session on one machine names none; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ruleloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/ruleloom-{label}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Memo(dict):
    """Remembers what ``make`` gives, in two generations of at most ``most`` entries each.

    Keys of over LONGEST_KEPT characters are made anew each time, so the bound on entries bounds the memory.
    """

    def __init__(self, make: Callable, most: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in small pieces, so that only a piece's texts become Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (two multiply-xorshift rounds), elementwise on uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Ids of 8 bytes that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(spark: SparkSession, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ``dropped`` (doc_id); all columns stay, null ids too."""
    ids = written(spark, dropped.select(F.col("doc_id").cast("long").alias("_dropped")).dropna().distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["_dropped"], "left_anti")

"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import contextlib
import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a folder of its own on one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ruleloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of Parquet files that may be sent to every executor; terms may be long texts, so rows alone are no bound.
BROADCAST_BYTES = 64 << 20
#: Estimated bytes to be shuffled in one pass, and how many passes there are at most (beyond that each one is larger).
PASS_BYTES, MOST_PASSES = 160 << 20, 32
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/ruleloom-{label}-{uuid.uuid4().hex}"


def fits(table: DataFrame, rows: int, counted: int | None = None) -> bool:
    """Whether a stored table is small enough to be broadcast, by its rows and the bytes of its files."""
    if (table.count() if counted is None else counted) > rows:
        return False
    return planned_bytes(table) <= BROADCAST_BYTES


def planned_bytes(df: DataFrame) -> int:
    """Spark's estimate of df's size; for a stored table the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def passes_for(df: DataFrame) -> int:
    """In how many passes to shuffle df, so that only a part of it lies in shuffle files at a time."""
    return min(-(-planned_bytes(df) // PASS_BYTES), MOST_PASSES) or 1


def in_pass(k: int, passes: int, by: Column) -> Column:
    """Whether a row belongs to pass k: every row, nulls too, belongs to one."""
    return F.pmod(F.xxhash64(by), F.lit(passes)) == k


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it has run, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLES_DROPPED, None)
    spark.conf.set(SHUFFLES_DROPPED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_DROPPED)
        else:
            spark.conf.set(SHUFFLES_DROPPED, before)


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df as a Parquet table of its own."""
    return written_parts([df], label)


def written_parts(parts: list[DataFrame], label: str) -> DataFrame:
    """Parts of one schema as a Parquet table, one after the other; each one's shuffle files go before the next."""
    spark = parts[0].sparkSession
    path = fresh_path(spark, label)
    with shuffles_dropped(spark):
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def dealt(parts: list[DataFrame], key: str, buckets: int, label: str, into: str | None = None) -> DataFrame:
    """Parts as a Parquet table in buckets by the hash of ``key``: groups by it, and joins with tables in as many, don't shuffle.

    Columns in zstd take a third of the room that the rows have in shuffle files. ``into`` is a path by ``fresh_path``, to
    which such parts may have been written before.
    """
    spark = parts[0].sparkSession
    path = into or fresh_path(spark, label)
    name = posixpath.basename(path).replace("-", "_")
    with shuffles_dropped(spark):
        for df in parts:
            out = df.write.mode("append").format("parquet").bucketBy(buckets, key).option("compression", "zstd")
            out.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("path", path).saveAsTable(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def removed(table: DataFrame) -> None:
    """Deletes a table that ``written`` or ``dealt`` made, once nothing reads it any more."""
    spark = table.sparkSession
    for path in {posixpath.dirname(x) for x in table.inputFiles()}:
        if posixpath.basename(path).startswith("ruleloom-"):
            spark.sql(f"DROP TABLE IF EXISTS {posixpath.basename(path).replace('-', '_')}")
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)

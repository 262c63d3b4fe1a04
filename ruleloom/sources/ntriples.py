"""N-Triples text: reading, parsing, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: subject, predicate, object; a literal keeps its quotes, escapes, language tag and datatype.
TRIPLE_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*+"\S*)\s*\.\s*$'
BLANK_LINE = r"^\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(value, file): lines of text files, gzip too; ``pattern`` is a file name glob."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select("value", F.input_file_name().alias("file"))


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds s, p, o and ``ok``: null for blank and comment lines, false for malformed ones."""
    text = F.col(line)
    part = lambda k: F.when(text.rlike(TRIPLE_LINE), F.regexp_extract(text, TRIPLE_LINE, k))
    ok = F.when(text.isNull() | text.rlike(BLANK_LINE), F.lit(None).cast("boolean")).otherwise(text.rlike(TRIPLE_LINE))
    return lines.withColumns({"s": part(1), "p": part(2), "o": part(3), "ok": ok})


def counts(parsed: DataFrame) -> DataFrame:
    """(parsed, malformed): one row."""
    return parsed.agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("malformed"))


def own_bnodes(term: Column, file: Column) -> Column:
    """Blank nodes renamed by their file, since labels are only unique in one."""
    name = F.regexp_replace(file, "[^A-Za-z0-9]", "")
    return F.when(term.startswith("_:"), F.concat(F.lit("_:"), name, F.substring(term, 3, 1 << 30))).otherwise(term)


def good(parsed: DataFrame, rename_bnodes: bool = False) -> DataFrame:
    """(s, p, o) of the well-formed lines, repeats included."""
    rows = parsed.filter("ok")
    if rename_bnodes:
        rows = rows.withColumns({c: own_bnodes(F.col(c), F.col("file")) for c in ("s", "o")})
    return rows.select("s", "p", "o")


def observed(parsed: DataFrame, rename_bnodes: bool = False) -> tuple[DataFrame, Observation]:
    """The well-formed triples, and counters that whatever runs over them fills on the way."""
    seen = Observation("ntriples")
    watched = parsed.observe(seen, F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("malformed"))
    return good(watched, rename_bnodes), seen


def read(spark: SparkSession, path: str, rename_bnodes: bool = False, pattern: str | None = None) -> DataFrame:
    """(s, p, o) of the well-formed lines of files."""
    return good(parse(read_lines(spark, path, pattern)), rename_bnodes)


def as_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    as_lines(triples).write.mode(mode).option("compression", compression).text(path)

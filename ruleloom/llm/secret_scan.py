"""Secret scan: fixed formats, and a battery of randomness tests on other tokens.

Candidates are runs of 16 or more letters, digits and +/_=- that lie in no base match and have at
least two of the classes small letters, capitals and digits (of one class alone, a random token and a
word or number can't be told apart by these tests). A candidate's encoding (hex, base32, base64, ...)
is inferred from its characters, and three tests are made: chi-squared uniformity over the encoding's
alphabet, by the rate of equal pairs of characters; runs of character classes; and lag-one serial
correlation of places in the alphabet. Each statistic is known for uniformly random tokens from the
alphabet, and for ordinary text and identifiers from ORDINARY. Its distance from ordinary towards
random is a normal deviate, less what it lies beyond random (a token far more regular than chance
isn't random either). The three are combined by Stouffer's method, each with the weight by which it
tells random from ordinary in this encoding, to a p-value against ordinary text.
Benjamini-Hochberg then runs over all candidates of all documents within classes of length, so that
short tokens, of which there are many, need more evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, texts, written

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Inferred encodings, narrowest first: name, characters, size of the alphabet.
ENCODINGS = [
    ("hex", re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z"), 16),
    ("base32", re.compile(r"[A-Z2-7]+=*\Z"), 32),
    ("lower36", re.compile(r"[a-z0-9]+\Z"), 36),
    ("upper36", re.compile(r"[A-Z0-9]+\Z"), 36),
    ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 62),
    ("base64", re.compile(r"[A-Za-z0-9+/]+=*\Z"), 64),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+=*\Z"), 64),
    ("mixed", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 66),
]
ORDER = {c: k for k, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=")}

#: Of ordinary tokens (words in any case, numbers and separators, put together at random): the mean of each statistic
#: and its standard deviation times the square root of the length; the tests check the tails.
ORDINARY = {"collisions": (0.041, 0.085), "changes": (0.05, 0.25), "serial": (0.32, 1.6)}
#: The same for tokens of hex digits alone, which are dates and numbers rather than words.
ORDINARY_HEX = {"collisions": (0.09, 0.12), "changes": (0.05, 0.25), "serial": (0.32, 1.6)}
#: Standard deviations of the statistics of random tokens, as above, how many of them beyond their mean a token may
#: lie before it counts as too regular, and how often what it lies beyond is taken off.
RANDOM_SPREAD, TOO_REGULAR, REGULARITY_COSTS = {"collisions": 0.08, "changes": 0.5, "serial": 0.95}, 2.5, 6
#: The most that one test counts, in standard deviations.
MOST_DEVIATION = 8.0
#: Upper ends of the classes of length.
LENGTHS = [20, 24, 32, 48, 64]
FALSE_DISCOVERY = 0.01
BIN = 0.25
#: The highest bin of -log10 of a p-value: those below 1e-30 count as 1e-30.
TOP_BIN = 120

SPAN = "array<struct<kind:int,start:long,end:long>>"
SCHEMA = (
    f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPAN},"
    " found array<struct<start:long,end:long,encoding:string,length_class:int,bin:int>>"
)


# ---- tests ----------------------------------------------------------------------------------


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _expected() -> dict[str, tuple[float, float]]:
    """For each encoding: rate of equal pairs and of class changes of uniformly random tokens."""
    out = {}
    for name, chars, size in ENCODINGS:
        # hex and base32 tokens are of one case
        own = [c for c in ORDER if chars.match(c) and not (name == "hex" and c in "abcdef") and c != "="]
        own = [c for c in own if _class(c) < 3]
        share = [sum(_class(c) == k for c in own) / len(own) for k in range(3)]
        out[name] = 1 / size, 1 - sum(x * x for x in share) - share[0] * share[1] * (1 + share[0])
    return out


def battery(token: str) -> tuple[str, float]:
    """(encoding, p-value against ordinary text)."""
    encoding = next(name for name, chars, _ in ENCODINGS if chars.match(token))
    body = token.rstrip("=") or token
    n = len(body)
    equal, differ = EXPECTED[encoding]
    # chi-squared over an alphabet of `size` is size / n * (2 * collisions + n) - n: it and this rate say the same
    collisions = sum(c * (c - 1) for c in Counter(body).values()) / (n * (n - 1))
    classes = [_class(c) for c in body]
    # a capital before a small letter starts a word, in prose and in identifiers alike; separators part words
    pairs = changes = 0
    for a, b, c in zip(classes, classes[1:], [*classes[2:], 3], strict=False):
        if a < 3 and b < 3:
            pairs += 1
            changes += a != b and (a, b) != (1, 0) and (a, b, c) != (0, 1, 0)
    changes /= max(1, pairs)
    places = [ORDER[c] for c in body]
    mean = sum(places) / n
    total = sum((p - mean) ** 2 for p in places)
    serial = sum((a - mean) * (b - mean) for a, b in zip(places, places[1:], strict=False)) / total if total else 1.0
    ordinary = ORDINARY_HEX if encoding == "hex" else ORDINARY
    z = weights = 0.0
    for name, value, random in (("collisions", collisions, equal), ("changes", changes, differ), ("serial", serial, -1 / n)):
        usual, spread = ordinary[name]
        towards = 1.0 if random > usual else -1.0
        beyond = max(0.0, towards * (value - random) - TOO_REGULAR * RANDOM_SPREAD[name] / math.sqrt(n))
        distance = towards * (value - usual) - REGULARITY_COSTS * beyond
        weight = abs(random - usual) / spread
        z += weight * min(MOST_DEVIATION, distance * math.sqrt(n) / spread)
        weights += weight * weight
    return encoding, 0.5 * math.erfc(z / math.sqrt(2 * weights))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


EXPECTED = _expected()


# ---- spans ----------------------------------------------------------------------------------


def _runs_over(text: bytes, table: bytes, least: int) -> bool:
    return b"x" * least in text.translate(table)


def _table(chars: str) -> bytes:
    return bytes(120 if chr(b) in chars else 32 for b in range(256))


HEX_BYTES = _table("0123456789abcdef")
TOKEN_BYTES = _table("".join(ORDER))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, sorted."""
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _runs_over(raw, HEX_BYTES, 24):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens of two classes of characters or more, outside base spans, with their tests."""
    if not _runs_over(text.encode(), TOKEN_BYTES, 16):
        return []
    out = []
    inside, k, reach = base, 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(inside) and inside[k][0] < m.end():
            reach = max(reach, inside[k][2])
            k += 1
        token = m.group()
        if m.start() < reach or len({_class(c) for c in token} - {3}) < 2:
            continue
        encoding, p = battery(token)
        out.append(
            {
                "start": m.start(), "end": m.end(), "encoding": encoding, "length_class": length_class(len(token)),
                "bin": min(TOP_BIN, int(-math.log10(max(p, 1e-300)) / BIN)),
            }
        )
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scored(docs: DataFrame) -> DataFrame:
    """Base spans and tested candidates of every document (null text: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                base = base_spans(text)
                n = Counter(k for _, k, _ in base)
                rows.append(
                    {
                        "doc_id": doc, "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                        "base_sha256": hashlib.sha256(span_text(base).encode()).hexdigest(),
                        "base": [{"kind": k, "start": a, "end": b} for a, k, b in base], "found": candidates(text, base),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
        ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length_class", pa.int32()), ("bin", pa.int32())]))),
    ]
)


def thresholds(scores: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> dict[int, int]:
    """The lowest accepted bin of each class of length, by Benjamini-Hochberg over all candidates.

    The table that reaches the driver has one row for each class of length.
    """
    bins = (
        scores.select(F.explode("found").alias("f"))
        .groupBy(F.col("f.length_class").alias("length_class"), F.col("f.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("length_class")
    rank = F.sum("n").over(w.orderBy(F.col("bin").desc()))
    # a bin's largest p-value stands for all in it
    passes = F.pow(F.lit(10.0), -F.col("bin") * BIN) <= false_discovery * F.col("rank") / F.col("total")
    rows = (
        bins.withColumn("rank", rank)
        .withColumn("total", F.sum("n").over(w))
        .filter(passes)
        .groupBy("length_class")
        .agg(F.min("bin").alias("least"))
        .collect()
    )
    return {r["length_class"]: r["least"] for r in rows}


def scan(spark: SparkSession, docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of docs.

    Null and empty texts have no spans; repeated rows stay repeated, and a null doc_id stays null.
    """
    scores = written(spark, scored(docs), "secrets")
    least = thresholds(scores, false_discovery)
    random = F.expr(
        "filter(found, x -> " + (" or ".join(f"(x.length_class = {k} and x.bin >= {b})" for k, b in sorted(least.items())) or "false") + ")"
    )
    every = F.expr(
        "array_sort(concat(transform(base, b -> struct(b.start as start, b.kind as kind, b.end as end)),"
        " transform(random, r -> struct(r.start as start, 3 as kind, r.end as end))))"
    )
    names = "element_at(array('assign', 'access', 'hex', 'random'), s.kind + 1)"
    return (
        scores.withColumn("random", random)
        .withColumn("all", every)
        .select(
            "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
            F.expr(f"array_join(transform(all, s -> concat({names}, ':', s.start, ':', s.end)), ',')").alias("spans"),
            F.size("random").cast("long").alias("n_random"),
        )
    )


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of ``scan`` replaced by ``mark`` (overlapping spans by one) and n_chars to match.

    Other columns, null texts and texts without spans stay as they are, and so do rows that repeat a
    doc_id or have none: each is read by itself, and all count in the false-discovery control.
    """
    least = thresholds(written(spark, scored(docs), "secrets"))
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new, sizes = [], []
            for text in batch.column(names.index("text")).to_pylist():
                spans = []
                if text:
                    base = base_spans(text)
                    spans = [(a, b) for a, _, b in base]
                    spans += [(f["start"], f["end"]) for f in candidates(text, base) if f["bin"] >= least.get(f["length_class"], TOP_BIN + 1)]
                if spans:
                    pieces, at = [], 0
                    for a, b in sorted(spans):
                        if a >= at:
                            pieces += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join([*pieces, text[at:]])
                new.append(text)
                sizes.append(len(text) if spans else None)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([o if s is None else s for o, s in zip(old, sizes, strict=True)], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)

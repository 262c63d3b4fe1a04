"""Licence scan: ordered signature rules behind keyword gates, with containment suppression.

Words are maximal runs of digits, ASCII letters and non-ASCII characters after A-Z are lower-cased;
rules see the words joined by single spaces. Of overlapping matches, one that lies inside a match of
a rule of higher priority (or of the same rule) is suppressed. Positions are word numbers from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices
from .license_rules import BASE_PHRASES, rules

#: ASCII letters (lower-cased), digits and all bytes of non-ASCII characters stay; the rest is space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BASE_WEIGHT = 0.7

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, n_detections long, detections array<struct<label:string,rule:int,start:long,end:long>>"
)


class Scanner:
    def __init__(self, table=None):
        self.rules = [
            (label, weight, keyword.encode(), re.compile(rb"(?:(?<= )|\A)(?:" + pattern.encode() + rb")(?= |\Z)"))
            for label, weight, keyword, pattern in table or rules()
        ]
        self.keywords = sorted({r[2] for r in self.rules})
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in BASE_PHRASES.items()]

    def scan(self, text: bytes) -> dict:
        words = text.translate(WORD_BYTES).split()
        joined = b" ".join(words)
        starts, labels = self._base(joined)
        found = self._detect(joined)
        weights: dict[str, float] = {label: BASE_WEIGHT for label in labels}
        for _, _, rule in found:
            label, weight = self.rules[rule][:2]
            weights[label] = max(weight, weights.get(label, 0.0))
        miss = 1.0
        for label in sorted(weights):
            miss *= 1.0 - weights[label]
        number = _word_numbers(joined, [x for d in found for x in d[:2]])
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(weights)),
            "score": 1.0 - miss if weights else 0.0,
            "n_detections": len(found),
            "detections": [
                {"label": self.rules[r][0], "rule": r, "start": number[a], "end": number[b] + 1} for a, b, r in found
            ],
        }

    def _base(self, joined: bytes) -> tuple[list[int], set[str]]:
        padded = b" " + joined + b" "
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = padded.find(phrase, at + 1)
        number = _word_numbers(joined, places)
        return [number[p] for p in places], labels

    def _detect(self, joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of the joined words, by start."""
        present = {k for k in self.keywords if k in joined}
        if not present:
            return []
        hits = [
            (m.start(), m.end(), rule)
            for rule, (_, _, keyword, pattern) in enumerate(self.rules)
            if keyword in present
            for m in pattern.finditer(joined)
        ]
        hits.sort(key=lambda h: (h[0], -h[1], h[2]))
        kept, cluster, reach = [], [], -1
        for hit in hits:
            if hit[0] >= reach and cluster:
                kept += _uncontained(cluster)
                cluster = []
            cluster.append(hit)
            reach = max(reach, hit[1])
        return kept + _uncontained(cluster)


def _uncontained(cluster: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping hits without those inside a hit of higher priority."""
    return [
        (a, b, r) for a, b, r in cluster if not any(c <= a and b <= d and q < r for c, d, q in cluster)
    ]


def _word_numbers(joined: bytes, places: list[int]) -> dict[int, int]:
    """The number of words that end before each byte position, in one pass."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += joined.count(b" ", at, p)
        at = max(at, p)
        out[p] = n
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), with its detections.

    A null or empty text, and one without words, has no places, empty label lists and score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            rows = [scanner.scan(t) for t in byte_texts(batch.column("text"))]
            for row, doc in zip(rows, batch.column("doc_id").to_pylist(), strict=True):
                row["doc_id"] = doc
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("n_detections", pa.int64()),
        ("detections", pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)

"""Byte-level BPE encoding and decoding with contiguous rank arrays.

Words are encoded many at a time: a matrix row holds a short word's parts (its boundaries are the
row's filled columns) and a second one the ranks of adjacent parts. Each round finds every row's
lowest rank (leftmost on ties), deletes that boundary by closing the gap, and refreshes the two
neighbouring ranks. Words of over SHORT bytes keep the same rule with a heap over linked parts,
as scanning costs the square of a word's length.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_KEPT, slices, texts

#: Bytes of a word up to which ranks are scanned.
SHORT = 48
#: Pieces that a worker remembers (of LONGEST_KEPT characters at most) before it starts anew.
WORDS_KEPT = 400_000

#: Unicode White_Space; Python's own \s also takes U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Cuts where the full pattern always cuts: before a space with a word, and around white space.
SEGMENT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

NO_RANK = np.int32(1 << 30)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class ByteBPE:
    """Encodes and decodes as the vocabulary file (tokenizers JSON, byte-level BPE) says."""

    def __init__(self, tokenizer_json: str):
        import regex

        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        self.pattern = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.added_pattern = (
            re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        )
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.added}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.id_of_byte = np.zeros(256, np.int64)
        for b, letter in byte_letters().items():
            self.id_of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # an id is below 2**20, so a pair is one integer
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        ranks = np.arange(len(pairs), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], ranks[order], made[np.argsort(ranks)]
        self.rank_of = dict(zip(keys.tolist(), ranks.tolist(), strict=True))
        self._slots()
        self.memo: dict[str, bytes] = {}

    def _slots(self) -> None:
        """A hash table of the pairs: one probe finds nearly all, a sorted search the rest."""
        self.slot_bits = 18
        slot = self._slot(self.keys)
        self.slot_key = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.slot_bits, NO_RANK, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = self.keys, self.ranks
        lost = self.slot_key[slot] != self.keys
        self.crowded = np.zeros(1 << self.slot_bits, bool)
        self.crowded[slot[lost]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20 | right).ravel()
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_rank[slot], NO_RANK)
        miss = np.flatnonzero(self.crowded[slot] & (out == NO_RANK))
        if len(miss):
            at = np.minimum(np.searchsorted(self.keys, keys[miss]), len(self.keys) - 1)
            out[miss] = np.where(self.keys[at] == keys[miss], self.ranks[at], NO_RANK)
        return out.reshape(left.shape)

    # ---- words ------------------------------------------------------------------------------

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Words of 1 to SHORT bytes, all rows in step."""
        sizes = np.array([len(w) for w in words], np.int64)
        wide = int(sizes.max())
        flat = np.frombuffer(b"".join([w.ljust(wide, b"\0") for w in words]), np.uint8).reshape(len(words), wide)
        columns = np.arange(wide)
        parts = self.id_of_byte[flat]
        ranks = np.full((len(words), wide), NO_RANK, np.int32)
        if wide > 1:
            ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
            ranks[columns >= sizes[:, None] - 1] = NO_RANK
        out, left_of = np.empty_like(parts), np.empty_like(sizes)
        live = np.arange(len(words))
        while True:
            n = np.arange(len(live))
            at = ranks.argmin(axis=1)
            best = ranks[n, at]
            go = best < NO_RANK
            if not go.all():
                done = ~go
                out[live[done]], left_of[live[done]] = parts[done], sizes[done]
                live, parts, ranks, sizes, at, best = live[go], parts[go], ranks[go], sizes[go], at[go], best[go]
                n = n[: len(live)]
                if not len(live):
                    break
            gap = columns[:-1] > at[:, None]
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=gap)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=gap)
            ranks[:, -1] = NO_RANK
            sizes -= 1
            made = self.made[best]
            parts[n, at] = made
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, wide - 1)
            both = self.pair_ranks(
                np.concatenate([parts[n, before], made]), np.concatenate([made, parts[n, after]])
            )
            lower, upper = both[: len(n)], both[len(n) :]
            ranks[n, at] = np.where(at < sizes - 1, upper, NO_RANK)
            has = at > 0
            ranks[n[has], before[has]] = lower[has]
        packed = out.astype("<u4")
        return [row[:k].tobytes() for row, k in zip(packed, left_of.tolist(), strict=True)]

    def encode_long(self, word: bytes) -> bytes:
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        alive = [True] * len(ids)
        heap = [
            (r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank_of.get(a << 20 | b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = int(self.made[rank]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (r := self.rank_of.get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word alone (as the pattern has cut it), in blocks of words of like length."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        order = sorted((k for k, w in enumerate(raw) if 0 < len(w) <= SHORT), key=lambda k: len(raw[k]))
        for start in range(0, len(order), 4096):
            block = order[start : start + 4096]
            for k, ids in zip(block, self.encode_short([raw[k] for k in block]), strict=True):
                out[k] = ids
        for k, w in enumerate(raw):
            if len(w) > SHORT:
                out[k] = self.encode_long(w)
        return out

    # ---- texts ------------------------------------------------------------------------------

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        if len(self.memo) > WORDS_KEPT:
            self.memo.clear()
        get = self.memo.get
        out: list[bytes | list] = []
        gaps: dict[int, list[tuple[int, str]]] = {}
        for text in batch:
            pieces = self._cut(text)
            row = list(map(get, pieces))
            if None in row:
                gaps[len(out)] = [(k, pieces[k]) for k, x in enumerate(row) if x is None]
                out.append(row)
            else:
                out.append(b"".join(row))
        if gaps:
            new = list({s for gap in gaps.values() for _, s in gap})
            # a lone run of letters, spaced or not, is a word by itself
            words_of = [[s] if s.removeprefix(" ").isalpha() else self.pattern.findall(s) for s in new]
            words = list({w for ws in words_of for w in ws})
            ids_of = dict(zip(words, self.encode_words(words), strict=True))
            fresh = {s: b"".join([ids_of[w] for w in ws]) for s, ws in zip(new, words_of, strict=True)}
            for content, i in self.added.items():
                fresh[content] = np.array([i], "<u4").tobytes()
            for at, gap in gaps.items():
                row = out[at]
                for k, piece in gap:
                    row[k] = fresh[piece]
                out[at] = b"".join(row)
            self.memo.update({s: ids for s, ids in fresh.items() if len(s) <= LONGEST_KEPT})
        return out

    def _cut(self, text: str) -> list[str]:
        if self.added_pattern is None or not self.added_pattern.search(text):
            return SEGMENT.findall(text)
        pieces, at = [], 0
        for m in self.added_pattern.finditer(text):
            pieces += [*SEGMENT.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return pieces + SEGMENT.findall(text[at:])

    def decode(self, ids: bytes) -> str:
        """Bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, tokenizer_json: str, describe, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Encodes ``text`` (null: empty) and returns ``describe(bpe, batch, ids)`` of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(tokenizer_json)
        for part in slices(batches, 512):
            yield describe(bpe, part, bpe.encode_batch(texts(part.column("text"))))

    return docs.select(*(keep or ["doc_id"]), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian uint32 bytes. Null and empty texts have none."""

    def describe(_: ByteBPE, part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "n_tokens", "ids"],
        )

    return encoded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer_json, describe, "doc_id long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, after encoding and decoding it.

    Null and empty texts give 0 tokens and the hashes of nothing; repeated rows stay repeated.
    """
    import hashlib

    def describe(bpe: ByteBPE, part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer_json, describe, schema)

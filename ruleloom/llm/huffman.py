"""Token ids as canonical, length-limited Huffman blocks.

File format: a Parquet dataset ``blocks`` whose rows are independent blocks, and a Parquet
dataset ``codebook`` of (id, bits). A block row holds

- ``part``, ``block``: its place; blocks hold documents in ascending doc_id order;
- ``first_doc``, ``first_id``: how many documents and ids of its part stand before it;
- ``doc_ids``, ``doc_tokens``: the documents in it and their id counts. Only a document of over
  BLOCK_IDS ids is cut: its pieces are the only content of their blocks, ``cut`` is true there and
  ``first_doc`` the same;
- ``n_ids``: how many ids its bit stream holds, ``payload``: the stream, most significant bit first;
- ``checkpoints``: the bit offset of every CHECKPOINT_IDS-th id, so that decoding starts anywhere
  and runs in lanes;
- ``crc``: CRC-32 of the payload.

Only code lengths are stored; codes follow from them canonically (by length, then id). Lengths
come from counts over the whole corpus by package-merge, so no code is longer than the limit and
one table of 2**limit entries decodes an id per step.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, scratch, slices, texts, written

CODE_LIMIT = 16
CHECKPOINT_IDS = 256
BLOCK_IDS = 1 << 18
END_ID = 2
#: Words that a worker remembers in each of two generations.
PIECES_KEPT = 400_000
#: Bytes of a document's ids that deal rows of one doc_id to several tasks.
PREFIX_BYTES = 16

BLOCK_SCHEMA = (
    "part int, block int, first_doc long, first_id long, cut boolean, doc_ids array<long>,"
    " doc_tokens array<long>, n_ids long, payload binary, checkpoints array<long>, crc long"
)


# ---- the code -------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = CODE_LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge).

    One symbol gets one bit. Raises ValueError if the symbols don't fit in ``limit`` bits.
    """
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    if n <= 1:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    packages = np.empty(0)
    is_package = []
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        is_package.append(rank >= n)
        items = items[rank]
        pairs = len(items) // 2
        packages = items[: 2 * pairs].reshape(pairs, 2).sum(axis=1)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_package):
        inner = int(flags[:take].sum())
        lengths[: take - inner] += 1
        take = 2 * inner
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes for (ids, lengths), with arrays for packing and one table for decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        rank = np.lexsort((ids, lengths))
        ids, lengths = np.asarray(ids, np.int64)[rank], np.asarray(lengths, np.int64)[rank]
        self.width = int(lengths.max()) if len(ids) else 1
        span = np.left_shift(1, self.width - lengths)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(ids) else np.empty(0, np.int64)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(top, np.uint32), np.zeros(top, np.int64)
        self.code[ids] = first >> (self.width - lengths)
        self.length[ids] = lengths
        self.symbol_at = np.zeros(1 << self.width, np.uint32)
        self.length_at = np.ones(1 << self.width, np.int64)
        filled = int(span.sum()) if len(ids) else 0
        self.symbol_at[:filled] = np.repeat(ids, span)
        self.length_at[:filled] = np.repeat(lengths, span)

    def pack(self, ids: np.ndarray, every: int = CHECKPOINT_IDS) -> tuple[bytes, np.ndarray]:
        """The bit stream of ids, and the bit offset of every ``every``-th of them."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        offsets = ends - lengths
        if not len(ids):
            return b"", offsets
        size = (int(ends[-1]) + 7) // 8
        # a code lies in at most two words of 32 bits; those that start in one word are neighbours
        word = offsets >> 5
        window = self.code[ids].astype(np.uint64) << (64 - (offsets & 31) - lengths).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        sums, at = np.add.reduceat(window, first), word[first]
        out = np.zeros(int(at[-1]) + 2, np.uint64)
        out[at] = sums >> np.uint64(32)
        out[at + 1] += sums & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[:size], offsets[::every]

    def unpack(self, payload: bytes, n_ids: int, checkpoints: np.ndarray, every: int = CHECKPOINT_IDS) -> np.ndarray:
        """The ids of a block: one lane for each checkpoint, all lanes step together."""
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = len(checkpoints)
        out = np.zeros((every, lanes), np.uint32)
        at = np.array(checkpoints, np.int64)
        last = n_ids - (lanes - 1) * every if lanes else 0
        down, mask, top = np.uint32(32 - self.width), np.uint32((1 << self.width) - 1), len(words) - 1
        for k in range(every if lanes > 1 else last):
            if k == last and lanes:
                at = at[:-1]
            peek = (words[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> down & mask
            out[k, : len(at)] = self.symbol_at[peek]
            at = at + self.length_at[peek]
        return out.T.reshape(-1)[:n_ids]


# ---- tokenizing -----------------------------------------------------------------------------


#: Lower-cases Latin-1 and makes its two spaces beyond ASCII plain ones.
LATIN_LOWER = bytes(
    32 if b in (0x85, 0xA0) else b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256)
)
#: What the splitter tells apart among these characters.
_LETTER = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGIT = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECE = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTER + rb"]+|[" + _DIGIT + rb"]|[^\t-\r " + _LETTER + _DIGIT + rb"]+"
)


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer_json: str, width: str):
    """Text -> the tokenizer's ids as packed integers; kept by a worker process for its next tasks.

    White space never reaches a token of this kind of tokenizer (its splitter drops it, and its
    normalizer has no rule that spans it), so words are encoded alone and remembered. In Latin-1 texts,
    which the normalizer only lower-cases, a new word is cut as the splitter does and its pieces go
    straight to the library's BPE model; words of other texts go through the whole library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    from .bpe import SPACE, byte_letters

    @functools.cache
    def whole():
        """The library's tokenizer, which holds vocabulary and merges a second time: made for the first word that needs it."""
        tok = Tokenizer.from_str(tokenizer_json)
        tok.no_truncation()
        tok.no_padding()
        return tok

    spec = json.loads(tokenizer_json)
    added = [x["content"] for x in spec["added_tokens"]]
    spec = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    # the pieces that come here are new, so the model's own memo would only cost time
    model = BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=spec["end_of_word_suffix"], cache_capacity=0)
    letter = byte_letters()
    kind = {"<u2": "H", "<u4": "I"}[width]

    def latin_ids(word: bytes) -> bytes:
        cut = LATIN_PIECE.findall(word)
        if len(cut) > 1:
            return b"".join(map(latin.__getitem__, cut))
        piece = cut[0]
        mapped = piece.decode() if PRINTABLE.fullmatch(piece) else "".join([letter[b] for b in piece.decode("latin-1").encode()])
        return array.array(kind, [x.id for x in model.tokenize(mapped)]).tobytes()

    def word_ids(word: str) -> bytes:
        return array.array(kind, whole().encode(word, add_special_tokens=False).ids).tobytes()

    latin, words = Memo(latin_ids, PIECES_KEPT), Memo(word_ids, PIECES_KEPT // 4)
    # str.split() also cuts at four controls which the tokenizer keeps as symbols
    plain = re.compile(f"[^{SPACE}]+")

    def encode(text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(words.__getitem__, plain.findall(text)))
        if any(x in text for x in added):
            return b"".join(map(words.__getitem__, plain.findall(text)))
        return b"".join(map(latin.__getitem__, raw.translate(LATIN_LOWER).split()))

    return encode


PRINTABLE = re.compile(rb"[!-~]+")


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, seen): the ids of each document as packed integers of 2 bytes if the vocabulary allows, else 4.

    A task's last row holds no document but, in ``seen``, what it counted (``packed_counts``).
    """
    width = tokenizer_width(tokenizer_json, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer_json, width), np.array([end_id], width).tobytes()
        total = np.zeros(0, np.int64)
        for batch in slices(batches):
            ids = [encode(t) + end for t in texts(batch.column("text"))]
            total = added_up(total, np.bincount(np.frombuffer(b"".join(ids), width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "seen"]
            )
        some = np.flatnonzero(total)
        if len(some):
            seen = packed_counts(some, total[some])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], pa.binary())], ["doc_id", "ids", "seen"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, seen binary"
    )


def packed_counts(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids and their numbers, few bytes each: every task writes one such row, however small its input."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + n.astype("<u8").tobytes(), 1)


def unpacked_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)


def added_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, the shorter one filled up with zeros."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def tokenizer_width(tokenizer_json: str, end_id: int = END_ID) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus, from the counts that the tokenizing tasks left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("seen").to_pylist():
                ids, n = unpacked_counts(raw)
                own = np.zeros(int(ids[-1]) + 1, np.int64)
                own[ids] = n
                total = added_up(total, own)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = tokens.filter("seen is not null").select("seen").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


# ---- writing and reading --------------------------------------------------------------------


def write_blocks(spark: SparkSession, docs: DataFrame, tokenizer_json: str, path: str, limit: int = CODE_LIMIT) -> None:
    """Encodes docs (doc_id, text) and writes ``path``/codebook and ``path``/blocks.

    Empty or null texts hold the end id alone. Rows with the same doc_id stay neighbours, in the
    order of the first PREFIX_BYTES of their ids, then of a hash of all; a null doc_id comes first. They
    are dealt to tasks by these too, so however many rows one doc_id has, no task gets all of them.
    An empty table gives empty datasets.
    """
    width = tokenizer_width(tokenizer_json)
    tokens = written(spark, tokenized(docs, tokenizer_json).withColumn("row", F.monotonically_increasing_id()), "tokens")
    # as many rows as the vocabulary has entries at most
    counted = id_counts(tokens).toPandas().sort_values("id")
    ids, n = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    lengths = code_lengths(n, max(limit, int(np.ceil(np.log2(max(len(ids), 2))))))
    spark.createDataFrame(
        pa.table({"id": pa.array(ids, pa.int64()), "bits": pa.array(lengths.astype(np.int32), pa.int32())})
    ).coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book, part = Codebook(*shared.value), TaskContext.get().partitionId()
        block, docs_before, ids_before = 0, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        n_held = 0

        def block_of(rows: list[tuple[int | None, np.ndarray]], cut: bool) -> pa.RecordBatch:
            nonlocal block, ids_before
            ids = np.concatenate([x[1] for x in rows]).astype(np.int64)
            payload, checkpoints = book.pack(ids)
            row = {
                "part": [part], "block": [block], "first_doc": [docs_before], "first_id": [ids_before], "cut": [cut],
                "doc_ids": [[x[0] for x in rows]], "doc_tokens": [[len(x[1]) for x in rows]], "n_ids": [len(ids)],
                "payload": [payload], "checkpoints": [checkpoints.tolist()], "crc": [zlib.crc32(payload)],
            }
            block, ids_before = block + 1, ids_before + len(ids)
            return pa.RecordBatch.from_pydict(row, schema=ARROW_BLOCK)

        for batch in slices(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(raw, width)
                if held and n_held + len(own) > BLOCK_IDS:
                    yield block_of(held, False)
                    docs_before += len(held)
                    held, n_held = [], 0
                if len(own) > BLOCK_IDS:
                    for at in range(0, len(own), BLOCK_IDS):
                        yield block_of([(doc, own[at : at + BLOCK_IDS])], True)
                    docs_before += 1
                else:
                    held.append((doc, own))
                    n_held += len(own)
        if held:
            yield block_of(held, False)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["doc_id", "prefix", "hash", "row"]
    ordered = (
        tokens.filter("seen is null")
        .select("doc_id", "ids", F.substring("ids", 1, PREFIX_BYTES).alias("prefix"), F.xxhash64("ids").alias("hash"), "row")
        .repartitionByRange(parts, *place)
        .sortWithinPartitions(*place)
        .select("doc_id", "ids")
    )
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


ARROW_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("first_id", pa.int64()), ("cut", pa.bool_()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()),
        ("payload", pa.binary()), ("checkpoints", pa.list_(pa.int64())), ("crc", pa.int64()),
    ]
)


def decoded(spark: SparkSession, path: str, schema: str, describe) -> DataFrame:
    """``describe(row, pieces)`` for each block row and the ids (uint32) of its documents; blocks need no others.

    Raises on a payload whose checksum is wrong.
    """
    book = spark.read.schema("id long, bits int").parquet(f"{path}/codebook").toPandas()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if zlib.crc32(row["payload"]) != row["crc"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                ids = codes.unpack(row["payload"], row["n_ids"], np.array(row["checkpoints"], np.int64)).astype("<u4")
                yield describe(row, np.split(ids, np.cumsum(row["doc_tokens"])[:-1]))

    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc, block, doc_id, ids): the decoded documents, ids as uint32 bytes; cut ones in pieces by block."""

    def describe(row: dict, pieces: list[np.ndarray]) -> pa.RecordBatch:
        n = len(pieces)
        columns = {
            "part": pa.array([row["part"]] * n, pa.int32()), "doc": pa.array(range(row["first_doc"], row["first_doc"] + n), pa.int64()),
            "block": pa.array([row["block"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "ids": pa.array([x.tobytes() for x in pieces], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    return decoded(spark, path, "part int, doc long, block int, doc_id long, ids binary", describe)


def crc32_join(crc_a: int, crc_b: int, len_b: int) -> int:
    """The CRC-32 of a+b from those of a and b: appends len_b zero bytes to a by squaring the shift matrix."""

    def times(matrix: list[int], x: int) -> int:
        total, k = 0, 0
        while x:
            if x & 1:
                total ^= matrix[k]
            x, k = x >> 1, k + 1
        return total

    shift = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    bits = 8 * len_b
    while bits:
        if bits & 1:
            crc_a = times(shift, crc_a)
        shift = [times(shift, column) for column in shift]
        bits >>= 1
    return crc_a ^ crc_b


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""

    def describe(row: dict, pieces: list[np.ndarray]) -> pa.RecordBatch:
        n = len(pieces)
        sizes = np.array(row["doc_tokens"], np.int64)
        columns = {
            "part": pa.array([row["part"]] * n, pa.int32()), "doc": pa.array(range(row["first_doc"], row["first_doc"] + n), pa.int64()),
            "cut": pa.array([row["cut"]] * n, pa.bool_()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "at": pa.array(row["first_id"] + np.cumsum(sizes) - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in pieces], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    schema = "part int, doc long, cut boolean, doc_id long, at long, n_tokens long, ids_crc32 long"
    pieces = written(spark, decoded(spark, path, schema, describe), "digest")

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                crc, size, at = 0, 0, row["pieces"][0]["at"]
                for piece in row.pop("pieces"):
                    crc = crc32_join(crc, piece["ids_crc32"], 4 * piece["n_tokens"]) if size else piece["ids_crc32"]
                    size += piece["n_tokens"]
                row |= {"at": at, "n_tokens": size, "ids_crc32": crc}
            names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int32() if k == "part" else pa.int64()) for k in names], names
            )

    whole = pieces.filter("not cut").select("part", "doc_id", "at", "n_tokens", "ids_crc32")
    joined = (
        pieces.filter("cut")
        .groupBy("part", "doc", "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n_tokens", "ids_crc32"))).alias("pieces"))
        .mapInArrow(join_pieces, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    )
    # parts are write tasks: a row each
    totals = pieces.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        whole.unionByName(joined)
        .join(F.broadcast(bases), "part")
        .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_digest(spark: SparkSession, docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Writes the corpus to the shared folder in this format and describes it from the files."""
    path = scratch(spark, "huffman")
    write_blocks(spark, docs, tokenizer_json, path)
    return digest(spark, path)

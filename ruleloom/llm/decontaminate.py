"""Benchmark decontamination by templates.

Texts become sequences of tokens in which numbers, names (capitalised words) and units (unit words
after a number) are typed placeholders; other words are lower-cased. Each text is seen four ways: with
capitalised words that open sentences as words, or as names; with all names as plain words, for copies
in another case; and by its exact tokens, for items with few words. Windows of WINDOW tokens (a
shorter item is one window) of documents and benchmark are joined on their hashes. A Bloom filter of
bounded size, made of the benchmark's hashes, keeps windows that can't match out of the join.

Matching windows of a document and an item on one diagonal form a run, and its slots must be
consistent: equal fillers on the benchmark's side have equal fillers in the document. An item leaked
into a document if accepted runs cover at least SHARE of its tokens, so a question asked again with
other numbers, names or units is caught, and a phrase in common is not. An excerpt of a long item is
caught by a run of at least RUN tokens, half of them words or unchanged names. Windows need
LITERAL_SHARE of literal tokens to match with other fillers; exact copies need none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, mix64, slices, stored_bytes, texts, written

WINDOW = 8
#: Of a window's tokens, the share that must be literal, and the fewest, for it to match by its template.
LITERAL_SHARE, FEWEST_LITERALS = 3 / 8, 2
SHARE = 0.6
#: Tokens of a run that is a leak whatever its share of the item.
RUN = 32
#: Of a run's slots, the share that must be consistent.
CONSISTENT = 0.8
#: Windows of the benchmark, and bytes of their files, up to which they are sent to every executor; more are shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 400_000, 32 << 20
#: Bits of the Bloom filter for each window of the benchmark, and all of them at most (as a power of two).
BITS_EACH, MOST_BITS = 1024, 26

#: Characters of scripts that are written without spaces are tokens by themselves.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f"
TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|[{UNSPACED}]|(?:(?![{UNSPACED}])[^\W\d_])+|[.!?\n]")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg ton tons tonne tonnes oz ounce ounces lb lbs pound pounds"
    " ml l liter liters litre litres gallon gallons pint pints cup cups s sec second seconds min minute minutes h hr hour hours day days"
    " week weeks month months year years percent pct degree degrees kmh mph hz khz mhz ghz w kw kwh v a j kj cal kcal n pa kpa"
    " dollar dollars cent cents euro euros pence usd eur gbp yen byte bytes kb mb gb tb bit bits".split()
)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3))
#: Sets exact windows apart from templates.
EXACT = np.uint64(0x5851F42D4C957F2D)
WORD_KIND, NAME_KIND, NUMBER_KIND, UNIT_KIND, END_KIND = range(5)
MASK = (1 << 60) - 1


class Canonical:
    """Texts as (templates, filler) arrays: placeholders and words, and what stood there.

    The templates have three rows: capitalised words that open sentences as words; as names; and all
    capitalised words as words.
    """

    def __init__(self):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        stops = {x: END_KIND.to_bytes(8, "little") for x in ".!?\n"}

        def code(token: str) -> bytes:
            c = token[0]
            if c in ".!?\n":
                return stops[c]
            low = token.lower()
            if c.isdigit():
                kind = NUMBER_KIND
            elif c.isupper() and len(token) > 1 and not token.isupper():
                kind = NAME_KIND
            else:
                kind = UNIT_KIND if low in UNITS else WORD_KIND
            return ((digest(low) & MASK) << 3 | kind).to_bytes(8, "little")

        def codes(chunk: str) -> bytes:
            # most chunks are one word, or a word and a mark
            if chunk.isascii() and chunk[:-1].isalpha():
                last = chunk[-1]
                if last.isalpha():
                    return code(chunk)
                if last in ",;:.!?":
                    return self.codes[chunk[:-1]] + stops.get(last, b"")
            return b"".join(map(code, TOKEN.findall(chunk)))

        # tokens never span a blank or a line's end, so what stands between them is remembered
        self.codes = Memo(codes)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        chunks = text.replace("\n", " \n ").split(" ")
        codes = np.frombuffer(b"".join(map(self.codes.__getitem__, chunks)), np.uint64)
        kind = (codes & np.uint64(7)).astype(np.int8)
        word = kind != END_KIND
        # a sentence starts at the beginning and after an end
        starts = np.ones(len(kind), bool)
        starts[1:] = ~word[:-1]
        starts, kind, filler = starts[word], kind[word], codes[word] >> np.uint64(3)
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = kind[:-1] == NUMBER_KIND
        template = np.stack([filler, filler, filler])
        template[:, kind == NUMBER_KIND] = NUMBER
        template[:, (kind == UNIT_KIND) & after_number] = UNIT
        name = kind == NAME_KIND
        template[1, name] = NAME
        template[0, name & ~starts] = NAME
        return template, filler


def is_slot(template: np.ndarray) -> np.ndarray:
    return (template == NUMBER) | (template == NAME) | (template == UNIT)


def hashes(rows: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` tokens, along the last axis."""
    n = rows.shape[-1] - size + 1
    factor, power, width, done, h = 0x9E3779B97F4A7C15, rows, 1, 0, None
    # windows of 1, 2, 4, ... tokens, joined for the bits of size
    while True:
        if size & width:
            piece = power[..., done : done + n]
            h = piece if h is None else h * np.uint64(factor) + piece
            done += width
        if 2 * width > size:
            return mix64(h + np.uint64(size))
        power = power[..., :-width] * np.uint64(factor) + power[..., width:]
        factor, width = factor * factor % (1 << 64), 2 * width


def enough(template: np.ndarray, size: int) -> np.ndarray:
    """Whether each window has literals enough."""
    literal = np.zeros((len(template), template.shape[1] + 1), np.int64)
    np.cumsum(~is_slot(template), axis=1, out=literal[:, 1:])
    return literal[:, size:] - literal[:, :-size] >= min(size, max(FEWEST_LITERALS, math.ceil(LITERAL_SHARE * size)))


def views(template: np.ndarray, filler: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which of them count) of every window in each of the four ways; a way that equals one before doesn't count."""
    words, names, plain, exact = h = hashes(np.vstack([template, filler]), size)
    counts = np.ones(h.shape, bool)
    counts[0] = words != exact
    counts[1] = (names != exact) & (names != words)
    counts[2] = (plain != exact) & (plain != words) & (plain != names)
    h[3] = exact ^ EXACT
    return h, counts


# ---- the benchmark ----------------------------------------------------------------------------

#: What a token is, for the check of slots: a slot if it opens a sentence as a word, as a name, and a number or unit.
SLOT, NAME_SLOT, MEASURE = 1, 2, 4
WINDOWS = "hash long, entry long, place int, size int, n_tokens int, fillers binary, flags binary"


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, (item_id, entry)): the windows of every text; items with the same tokens share an entry."""
    import xxhash

    def entry_of(template: np.ndarray, filler: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(template.tobytes() + filler.tobytes()) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in slices(batches, 64):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                template, filler = canonical(text)
                n = len(filler)
                if not n:
                    continue
                entry, size = entry_of(template, filler), min(WINDOW, n)
                words, names = is_slot(template[:2])
                kinds = template[0]
                flags = (words * SLOT | names * NAME_SLOT | ((kinds == NUMBER) | (kinds == UNIT)) * MEASURE).astype(np.uint8)
                h, counts = views(template, filler, size)
                # a window without slots is found by its exact tokens alone
                counts[:3] &= enough(template, size)
                for place in range(n - size + 1):
                    part = slice(place, place + size)
                    for k, value in enumerate(np.unique(h[counts[:, place], place])):
                        rows.append(
                            (int(value.view(np.int64)), entry, place, size, n, filler[part].tobytes(), flags[part].tobytes(), item, place + k == 0)
                        )
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["hash", "entry", "place", "size", "n_tokens", "fillers", "flags", "item_id", "first"],
            )

    made = written(items.sparkSession, items.mapInArrow(run, WINDOWS + ", item_id long, first boolean"), "benchmark")
    return made.drop("item_id", "first").dropDuplicates(["hash", "entry", "place"]), made.filter("first").select("item_id", "entry")


def bloom(windows: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, power): a filter of 2**power bits, of 8 MB at most, with two bits for each hash of the benchmark."""
    power = max(16, min(MOST_BITS, math.ceil(math.log2(max(1, windows.count()) * BITS_EACH))))
    at = windows.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - power), F.col("hash").bitwiseAND(F.lit((1 << power) - 1).cast("long")))).alias("v"))
    rows = (
        at.groupBy(F.bitmap_bucket_number("v").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << power) // 8 + 4096, np.uint8)
    for r in rows:
        # values from 1 on are in bucket 1, so value v has bit v - 1; value 0 has a bucket of its own
        start = (r["bucket"] - 1) * 4096
        own = np.frombuffer(r["bits"], np.uint8)
        if start >= 0:
            bits[start : start + 4096] |= own
        else:
            bits[-1] = 255
    return bits, power


def passes(h: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    """Whether each hash may be the benchmark's."""

    def probe(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64) - 1
        found = bits[v >> 3] >> (v & 7).astype(np.uint8) & 1
        return found.astype(bool)

    out = probe(h >> np.uint64(64 - power))
    some = np.nonzero(out)
    out[some] = probe(h[some] & np.uint64((1 << power) - 1))
    return out


# ---- documents --------------------------------------------------------------------------------


def candidate_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray, power: int) -> DataFrame:
    """(row, doc_id, hash, at, size, own): the windows of every text that pass the filter, with their fillers.

    ``row`` tells documents apart, as doc_ids may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, filter_ = Canonical(), shared.value
        for batch in slices(batches):
            out, ids = [], []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id")), texts(batch.column("text")), strict=True):
                template, filler = canonical(text)
                for size in sizes:
                    if len(filler) < size:
                        continue
                    h, counts = views(template, filler, size)
                    way, at = np.nonzero(counts & passes(h, filter_, power))
                    if len(at):
                        at, value = np.unique(np.stack([at, h[way, at].view(np.int64)]), axis=1)
                        own = np.lib.stride_tricks.sliding_window_view(filler, size)[at]
                        ids += [doc] * len(at)
                        out.append((np.full(len(at), row), value, at, np.full(len(at), size), [x.tobytes() for x in own]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(ids, pa.int64()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array([x for o in out for x in o[4]], pa.binary()),
                ],
                ["row", "doc_id", "hash", "at", "size", "own"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, hash long, at int, size int, own binary")


def judged(matches: list[tuple], n_tokens: int, share: float, run: int) -> tuple[int, float, int, int] | None:
    """(windows, covered share, slots, changed slots) of an item in a document, or None if it isn't found there.

    ``matches``: (diagonal, place, size, own fillers, the item's fillers, the item's flags), sorted.
    """
    covered = np.zeros(n_tokens, bool)
    n, n_slots, changed, long = 0, 0, 0, False
    start = 0
    while start < len(matches):
        end = start + 1
        while end < len(matches) and matches[end][0] == matches[start][0] and matches[end][1] <= matches[end - 1][1] + matches[end - 1][2]:
            end += 1
        low, high = matches[start][1], matches[end - 1][1] + matches[end - 1][2]
        ours, theirs, flags = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint8)
        windows = 0
        for k, (_, place, size, own, item, kinds) in enumerate(matches[start:end]):
            if k and place == matches[start + k - 1][1]:
                continue  # a window that matches in several ways counts once
            part = slice(place - low, place - low + size)
            theirs[part], ours[part], flags[part] = np.frombuffer(own, np.uint64), np.frombuffer(item, np.uint64), np.frombuffer(kinds, np.uint8)
            windows += 1
        # a sentence's first word is a slot if it changed, and so is a name that another case hides
        slots = (flags & NAME_SLOT > 0) & ((flags & SLOT > 0) | (ours != theirs))
        start = end
        if slots.any() and consistency(ours[slots], theirs[slots]) < CONSISTENT * int(slots.sum()):
            continue
        n += windows
        covered[low:high] = True
        n_slots += int(slots.sum())
        changed += int((ours[slots] != theirs[slots]).sum())
        told = (ours == theirs) & (flags & MEASURE == 0)
        long |= high - low >= run and 2 * int(told.sum()) >= high - low
    if not n or not (long or covered.mean() >= share):
        return None
    return n, float(covered.mean()), n_slots, changed


def consistency(ours: np.ndarray, theirs: np.ndarray) -> int:
    """How many slots agree with the commonest filler that stands for their own."""
    if not len(ours):
        return 0
    pairs, n = np.unique(np.stack([ours, theirs]), axis=1, return_counts=True)
    best: dict[int, int] = {}
    for k, own in enumerate(pairs[0].tolist()):
        best[own] = max(best.get(own, 0), int(n[k]))
    return sum(best.values())


def verified(matches: DataFrame, share: float, run: int) -> DataFrame:
    """(doc_id, entry, n_windows, covered, n_slots, n_changed) of the items found, from joined windows.

    Windows of one document and item come together, sorted; a group is no larger than its document.
    """
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["row", "entry", "diagonal", "place"]
    dealt = matches.repartition(parts, "row", "entry").sortWithinPartitions(*order)
    schema = "doc_id long, entry long, n_windows long, covered double, n_slots long, n_changed long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    wanted = ["row", "entry", "doc_id", "n_tokens", "diagonal", "place", "size", "own", "fillers", "flags"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, doc_id, tokens = None, None, 0

        def close() -> list[tuple]:
            got = judged(held, tokens, share, run) if held else None
            return [(doc_id, key[1], *got)] if got else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in wanted]
            for row, entry, doc, n, *match in zip(*columns, strict=True):
                if (row, entry) != key:
                    done += close()
                    key, doc_id, tokens, held = (row, entry), doc, n, []
                held.append(tuple(match))
            yield batch_of(done)
        yield batch_of(close())

    return dealt.select(*wanted).mapInArrow(check, schema)


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, covered, n_slots, n_changed): every document with every item found in it.

    Null and empty texts on either side match nothing; items without words neither, so an empty
    benchmark or an empty table gives no rows. Repeated items and repeated documents give rows of
    their own, and so do rows with a null doc_id or item_id, which stay null. Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", F.monotonically_increasing_id())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    windows, named = benchmark_windows(items)
    windows, named = written(spark, windows, "windows"), written(spark, named, "items")
    # an item shorter than a window is one window: seven sizes at most
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bits, power = bloom(windows)
    found = written(spark, candidate_windows(own, sizes, bits, power), "candidates")
    small = windows.count() <= BROADCAST_WINDOWS and stored_bytes(windows) <= BROADCAST_BYTES
    matches = found.join(F.broadcast(windows) if small else windows, ["hash", "size"]).withColumn("diagonal", F.col("at") - F.col("place"))
    hits = written(spark, verified(matches, share, run), "hits")
    return hits.join(named, "entry").select("doc_id", "item_id", "n_windows", "covered", "n_slots", "n_changed")

"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct shingles of words (A-Z lower-cased, cut at ASCII white space),
kept as 64-bit hashes. Documents with equal sets form a class, and only classes are compared.

1. Each class gets 256 min-hashes. BANDS bands of ROWS of them make keys; classes that share a key
   are candidates. A pair at the similarity sought shares no key with a chance of
   (1 - t**ROWS)**BANDS, 3 in a million at 0.8.
2. Of each key's classes, a pivot (the class that shares most) is paired with the others: as many
   pairs as rows. They are verified and linked, which joins most of a large group.
3. Keys that still hold classes of different groups have them compared in blocks of BLOCK classes,
   pairs of blocks when there are more. Only pairs of different groups, at the first band
   that they share, are looked at, so a group of copies costs no row for each of its pairs.
   These classes get MORE_HASHES further min-hashes, so that pairs just below the similarity,
   of which a group of copies has many, are told apart without looking at their sets.
4. Verification compares the signatures batch by batch and drops a pair as soon as, given the
   matches so far, the posterior chance of the sought similarity is below MISS. Survivors are
   confirmed on their full sets.
5. Groups are connected components of the confirmed links, found by rounds of neighbourhood minima.

All of it is joins and grouped aggregates over tables in the shared folder; nothing of the size of
the corpus reaches the driver.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, LOWER, Memo, byte_texts, mix64, slices, written

BANDS, ROWS, HASHES = 32, 5, 256
#: Further hashes of classes whose pairs stay undecided after these.
MORE_HASHES = 2048
#: Numbers of hashes after which a pair may be dropped: batches of 32, then of 256.
ENDS = [*range(32, HASHES + 1, 32), *range(HASHES + 256, HASHES + MORE_HASHES + 1, 256)]
#: A pair is dropped when the chance that it reaches the similarity is below this.
MISS = 1e-6
#: Classes compared at once.
BLOCK = 512
SEED = 20240607


# ---- sets and signatures ----------------------------------------------------------------------


def word_hashes():
    """Words -> uint64 hashes, remembered by word."""
    import xxhash

    memo = Memo(lambda w: xxhash.xxh3_64_intdigest(w))

    def run(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    return run


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k] + np.uint64(k + size))
    return np.unique(h)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    again = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (shingles, again))


def hash_family(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of each (a * x + b) mod 2**64 over the set, their upper halves."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(16, (1 << 17) // len(a))
    for start in range(0, len(shingles), step):
        out = np.minimum(out, (np.multiply.outer(a, shingles[start : start + step]) + b[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + minima[k : BANDS * ROWS : ROWS])
    return h.view(np.int64)


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys, sig): set size, 128-bit digest of the set, band keys, low bytes of the minima.

    Texts without words, null ones included, have n_shingles 0 and empty keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = word_hashes(), hash_family(HASHES)
        for batch in slices(batches):
            n, d1, d2, keys, sig = [], [], [], [], []
            for text in byte_texts(batch.column("text")):
                own = shingle_set(hashes(text.translate(LOWER).split()), shingle_words)
                n.append(len(own))
                if not len(own):
                    d1.append(0), d2.append(0), keys.append(None), sig.append(None)
                    continue
                x, y = set_digest(own)
                d1.append(x), d2.append(y)
                minima = min_hashes(own, a, b)
                keys.append(band_keys(minima))
                sig.append(minima.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "keys", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary"
    )


# ---- verification -----------------------------------------------------------------------------


@functools.cache
def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each of ENDS, the fewest matches that a pair needs to go on.

    With a uniform prior, P(J >= t | m of n match) = P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in ENDS:
        total, m = 0.0, -1
        while True:
            j = m + 1
            log = math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(threshold) + (n + 1 - j) * math.log1p(-threshold)
            total += math.exp(log)
            if total >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


def surviving(left: np.ndarray, right: np.ndarray, sizes_left: np.ndarray, sizes_right: np.ndarray, threshold: float) -> np.ndarray:
    """Indexes of the row pairs (signatures, set sizes) that may reach the threshold."""
    small, large = np.minimum(sizes_left, sizes_right), np.maximum(sizes_left, sizes_right)
    live = np.flatnonzero(small >= threshold * large - 1e-9)
    matches = np.zeros(len(live), np.int64)
    for start, end, least in zip([0, *ENDS], ENDS, least_matches(threshold), strict=False):
        if not len(live) or end > left.shape[1]:
            break
        part = slice(start, end)
        matches += (left[live, part] == right[live, part]).sum(axis=1)
        go = matches >= least
        live, matches = live[go], matches[go]
    return live


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def prune(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes that survive the comparison of signatures."""
    own = classes.select("class", "n_shingles", "sig")
    rows = (
        pairs.join(own.toDF("a", "na", "sa"), "a")
        .join(own.toDF("b", "nb", "sb"), "b")
        .select("a", "b", "na", "nb", "sa", "sb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            live = surviving(
                _matrix(batch.column("sa"), HASHES, np.uint8), _matrix(batch.column("sb"), HASHES, np.uint8),
                batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold,
            )
            yield batch.select(["a", "b"]).take(pa.array(live))

    return rows.mapInArrow(run, "a long, b long")


def shingle_arrays(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(class, d1, set): the full sets of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for part in slices(batches):
            sets = [shingle_set(hashes(t.translate(LOWER).split()), shingle_words) for t in byte_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("class"), pa.array([set_digest(x)[0] if len(x) else 0 for x in sets], pa.int64()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["class", "d1", "set"],
            )

    return docs.mapInArrow(run, "class long, d1 long, set array<long>")


def texts_of(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(class, text) of the classes in ids (class)."""
    ids = written(spark, ids.distinct(), "wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col("doc_id").cast("long").alias("class"), F.col("text").cast("string").alias("text"))
    return own.join(ids, "class", "left_semi")


def further_signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(class, d1, more): MORE_HASHES further min-hashes' low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = word_hashes(), hash_family(MORE_HASHES, SEED + 1)
        for part in slices(batches):
            sets = [shingle_set(hashes(t.translate(LOWER).split()), shingle_words) for t in byte_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("class"), pa.array([set_digest(x)[0] if len(x) else 0 for x in sets], pa.int64()),
                    pa.array([min_hashes(x, a, b).astype(np.uint8).tobytes() for x in sets], pa.binary()),
                ],
                ["class", "d1", "more"],
            )

    return docs.mapInArrow(run, "class long, d1 long, more binary")


def standing(spark: SparkSession, rows: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Of rows that repeat an id, the one that stands for it, told by its digest."""
    return written(
        spark, rows.join(classes.select("class", "d1"), ["class", "d1"], "left_semi").dropDuplicates(["class"]), label
    )


def confirm(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    own = texts_of(spark, docs, pairs.select(F.explode(F.array("a", "b")).alias("class")))
    sets = standing(spark, shingle_arrays(own, shingle_words), classes, "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


# ---- components -------------------------------------------------------------------------------


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is the smallest node reachable.

    Alternates between linking a node's larger neighbours to its smallest one and linking its smaller
    neighbours so, until nothing changes; the number of rounds grows with the logarithm of the size.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        # a table of its own, so that the join deals both sides anew and can split a hub's rows
        return written(spark, edges.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "low")

    edges = written(
        spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"
    )
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = written(spark, large, "edges")
        small = (
            large.join(smallest(large), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        edges = written(spark, small, "edges")
        before, size = size, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == size:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))


# ---- candidates -------------------------------------------------------------------------------


def pivot_pairs(spark: SparkSession, members: DataFrame) -> DataFrame:
    """(a, b): every class with the pivot of each of its keys."""
    weight = members.groupBy("class").agg(F.sum("size").alias("weight"))
    best = (
        members.join(weight, "class")
        .groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("class")).alias("minus"))).alias("best"))
        .select("key", (-F.col("best.minus")).alias("pivot"))
    )
    return (
        members.join(written(spark, best, "best"), "key")
        .filter("class != pivot")
        .select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"))
        .distinct()
    )


def open_pairs(
    spark: SparkSession, docs: DataFrame, members: DataFrame, labels: DataFrame, classes: DataFrame, shingle_words: int, threshold: float
) -> DataFrame:
    """(a, b): the surviving pairs that share a key but not yet a group.

    Keys of over BLOCK classes are cut into blocks by a hash, and each two blocks meet in a group of
    their own, so no task holds more than two blocks of a key at once.
    """
    named = written(
        spark,
        members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        ),
        "named",
    )
    spread = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = written(spark, spread.filter("low != high").select("key"), "mixed")
    left = written(spark, named.join(mixed, "key", "left_semi"), "left")
    own = texts_of(spark, docs, left.select("class"))
    more = standing(spark, further_signatures(own, shingle_words), classes, "more")
    signed = classes.join(more.select("class", "more"), "class").select("class", "n_shingles", "keys", F.concat("sig", "more").alias("sig"))
    rows = (
        left.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component")
        .join(written(spark, signed, "signed"), "class")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "class")

    def compare(key: int, i: int, j: int, rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, component = rows.column("class").to_numpy(), rows.column("component").to_numpy()
        if component.min() == component.max():
            return []
        sizes, own = rows.column("n_shingles").to_numpy(), rows.column("own").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = int(np.flatnonzero(bands[0] == key)[0])
        found = []
        for x in range(len(ids)):
            y = np.flatnonzero(component[x + 1 :] != component[x]) + x + 1
            if i != j:
                y = y[own[y] != own[x]]
            if band:
                y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            if not len(y):
                continue
            live = surviving(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y], np.full(len(y), sizes[x]), sizes[y], threshold)
            if len(live):
                found.append((np.full(len(live), ids[x]), ids[y[live]]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = compare(*place, pa.Table.from_batches(held)) if held else []
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for start, end in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                here = (int(key[start]), int(i[start]), int(j[start]))
                if here != place:
                    yield from close()
                    held, place = [], here
                held.append(batch.slice(start, end - start))
        yield from close()

    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---- the operator -----------------------------------------------------------------------------


def groups(spark: SparkSession, docs: DataFrame, shingle_words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets, and
    ``component_id`` is the smallest doc_id reachable over links. Without words, null texts
    included, a document is linked with nothing. Rows that repeat a doc_id stay repeated; if their
    texts differ, one of them (that of the smallest digest) stands for the id in links. A row with a
    null doc_id has a null component and is kept. An empty table gives no rows.
    """
    threshold = percent / 100
    every = written(spark, signatures(docs, shingle_words), "signatures")
    named = every.filter("doc_id is not null and n_shingles > 0")
    digest = ["d1", "d2", "n_shingles"]
    one = named.groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("s")).select("doc_id", "s.*")
    one = written(spark, one, "digests")
    heads = written(spark, one.groupBy(*digest).agg(F.min("doc_id").alias("class")), "heads")
    member = written(spark, one.join(heads, digest).select("doc_id", "class"), "members")
    classes = written(
        spark,
        named.join(heads.withColumnRenamed("class", "doc_id"), [*digest, "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("class"), "n_shingles", "d1", "keys", "sig")
        .dropDuplicates(["class"]),
        "classes",
    )
    keys = classes.select("class", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(spark, keys.join(written(spark, shared, "shared"), "key"), "buckets")

    pivots = written(spark, prune(pivot_pairs(spark, members), classes, threshold), "pivots")
    links = written(spark, confirm(spark, docs, classes, pivots, shingle_words, percent), "links")
    labels = written(spark, components(spark, links), "labels")

    rest = written(spark, open_pairs(spark, docs, members, labels, classes, shingle_words, threshold), "open")
    more = confirm(spark, docs, classes, rest, shingle_words, percent)
    # groups so far stand for their members
    merged = written(
        spark,
        more.join(labels.toDF("a", "ca"), "a", "left")
        .join(labels.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        .distinct(),
        "merged",
    )
    final = written(spark, components(spark, merged), "final")
    of_class = labels.join(final.toDF("component", "last"), "component", "left").select(
        "node", F.coalesce("last", "component").alias("component")
    )
    # classes that had no link in the first round
    single = final.join(labels.select("node"), "node", "left_anti")
    of_class = written(spark, of_class.unionByName(single), "components")

    # only documents in a group that starts with another one need to be looked up
    moved = (
        member.join(of_class.withColumnRenamed("node", "class"), "class", "left")
        .select("doc_id", F.coalesce("component", "class").alias("component_id"))
        .filter("component_id != doc_id")
    )
    return (
        every.select("doc_id", "n_shingles")
        .join(written(spark, moved, "moved"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.col("component_id").isNull().alias("kept"),
        )
    )

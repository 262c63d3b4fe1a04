"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 characters of the lower-cased text. Document counts of both
classes give r = log((p + a) / |p| : (q + a) / |q|) for each; the n-grams whose r is LEAST_Z standard
errors from zero stay. Each gives two features, its presence and the logarithm of its density in the
text, both times r, and a logistic regression sets their weights: L-BFGS on the driver, which holds
vectors of the features' number (2**BITS at most) alone, with losses and gradients summed in tasks.
Counts and training rows come from a bounded sample of labelled rows (SAMPLE, the rows with the
smallest hash of doc_id); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts, written

#: Bound on labelled rows that train the classifier.
SAMPLE = 20_000
BITS = 20
ORDERS = (3, 4, 5, 6)
ALPHA = 1.0
#: How sure a feature's ratio must be.
LEAST_Z = 3.0
FOLDS = 5
#: Where the damping of densities sets in.
BENT = 4.0
#: Files of training rows: as many partial sums come to the driver for each gradient.
PARTS = 8
#: Steps of L-BFGS at most, those it remembers, and the fall of the loss, as a share, at which it stops.
ROUNDS, REMEMBERED, SETTLED = 100, 8, 1e-5
L2 = 1.0


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text, repeats included."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for order in ORDERS:
        n = len(c) - order + 1
        if n <= 0:
            break
        h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h ^= c[k : k + n]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def present(ids: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the damped density of each: its number in a thousand n-grams, above BENT as a logarithm."""
    own, counts = np.unique(ids, return_counts=True)
    return own, BENT * np.log1p(counts * 1000.0 / (total + 400.0) / BENT)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents outside the held-out fold.

    Labels that are null are left out; of several labels of a document the largest counts, and of
    several texts the one of the smallest hash, so the bound holds for repeated rows too.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # as many rows of two numbers as the sample's bound
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows.select("text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg) document counts; feature -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in slices(batches):
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                side = int(toxic > 0)
                counts[side][np.unique(ngrams(text))] += 1
                n[side] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([seen, [-1]]), pa.int64())]
            + [pa.array(np.concatenate([counts[s][seen], [n[s]]]), pa.int64()) for s in (1, 0)],
            ["feature", "pos", "neg"],
        )

    return (
        rows.mapInArrow(run, "feature long, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def lbfgs(loss, w: np.ndarray) -> np.ndarray:
    """A minimum of ``loss``, which gives (value, gradient), by limited-memory BFGS with step halving."""
    value, g = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        d, keep = -g, []
        for s, y in reversed(moves):
            keep.append((s @ d) / (s @ y))
            d = d - keep[-1] * y
        if moves:
            s, y = moves[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.sqrt(g @ g))
        for (s, y), a in zip(moves, reversed(keep), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = g @ d, 1.0
        while True:
            new, grown = loss(w + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if new >= value:
            return w
        s, y = step * d, grown - g
        if s @ y > 1e-12:
            moves = [*moves[1 - REMEMBERED :], (s, y)]
        w, fall, value, g = w + s, value - new, new, grown
        if fall <= SETTLED * value:
            return w
    return w


def mean_loss(spark: SparkSession, data: DataFrame, scale: np.ndarray, n: int):
    """(weights and bias) -> the L2-penalised mean log loss over the stored rows, and its gradient, summed in tasks."""
    k = len(scale)

    def run_with(w: np.ndarray):
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            one, two, bias = w[:k] * scale, w[k:-1] * scale, w[-1]
            loss, g = 0.0, np.zeros(2 * k + 1)
            for batch in slices(batches, 64):
                hits = [np.frombuffer(x, "<u4") for x in batch.column("hits").to_pylist()]
                own = np.concatenate(hits).astype(np.int64)
                dense = np.frombuffer(b"".join(batch.column("dense").to_pylist()), "<f4").astype(np.float64)
                row = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
                y = batch.column("toxic").to_numpy() > 0
                z = bias + np.bincount(row, one[own] + two[own] * dense, minlength=len(hits))
                loss += float(np.logaddexp(0.0, np.where(y, -z, z)).sum())
                error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                g[:k] += np.bincount(own, error[row], minlength=k)
                g[k:-1] += np.bincount(own, error[row] * dense, minlength=k)
                g[-1] += error.sum()
            g[:k] *= scale
            g[k:-1] *= scale
            yield pa.RecordBatch.from_pydict({"loss": [loss], "g": [g.tobytes()]})

        return run, shared

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        run, shared = run_with(w)
        # PARTS rows at most
        got = data.mapInArrow(run, "loss double, g binary").collect()
        shared.destroy()
        free = np.append(w[:-1], 0.0)
        value = sum(r["loss"] for r in got) / n + 0.5 * L2 / n * (free @ free)
        return value, sum(np.frombuffer(r["g"]) for r in got) / n + L2 / n * free

    return loss


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-grams, weights of presence and density, bias). Without labels of both classes: no features, and the classes' share as bias."""
    rows = written(spark, training_rows(docs, labels, sample), "toxic")
    counts = feature_counts(rows)
    total = counts.filter("feature = -1").collect()
    pos, neg = (total[0]["pos"], total[0]["neg"]) if total else (0, 0)
    share = (pos + 0.5) / (pos + neg + 1)
    none = np.empty(0, np.int64), np.empty((2, 0)), float(np.log(share / (1 - share)))
    if not pos or not neg:
        return none
    # the log-count ratio, and its size in standard errors
    p, q = F.col("pos") + ALPHA, F.col("neg") + ALPHA
    ratio = F.log(p / (pos + 2 * ALPHA)) - F.log(q / (neg + 2 * ALPHA))
    kept = (
        counts.filter("feature >= 0")
        .withColumn("r", ratio)
        .withColumn("z", F.abs("r") / F.sqrt(1 / p + 1 / q))
        .filter(F.col("z") >= LEAST_Z)
        .select("feature", "r")
        .toPandas()
    )
    if not len(kept):
        return none
    # of 2**BITS features at most
    features, scale = kept["feature"].to_numpy(np.int64), kept["r"].to_numpy(float)
    order = np.argsort(features)
    features, scale = features[order], scale[order]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[features] = np.arange(len(features))
        for batch in slices(batches):
            hits, dense = [], []
            for text in texts(batch.column("text")):
                got = place[ngrams(text)]
                own, density = present(got[got >= 0], len(got))
                hits.append(own.astype("<u4").tobytes())
                dense.append(density.astype("<f4").tobytes())
            columns = [batch.column("toxic"), pa.array(hits, pa.binary()), pa.array(dense, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "hits", "dense"])

    data = written(spark, rows.mapInArrow(sparse, "toxic int, hits binary, dense binary").coalesce(PARTS), "toxic-rows")
    k = len(features)
    start = np.zeros(2 * k + 1)
    start[-1] = none[2]
    w = lbfgs(mean_loss(spark, data, scale, pos + neg), start)
    return features, np.stack([w[:k] * scale, w[k:-1] * scale]), float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts get the bias's score.

    Repeated rows stay repeated; a null doc_id stays null, and isn't held out, as no label can name it.
    Columns of docs beside doc_id and text are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        place[features] = np.arange(len(features))
        for batch in slices(batches):
            out = np.full(batch.num_rows, bias)
            for k, text in enumerate(texts(batch.column("text"))):
                got = place[ngrams(text)]
                own, density = present(got[got >= 0], len(got))
                out[k] += weights[0][own].sum() + weights[1][own] @ density
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    scores = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")

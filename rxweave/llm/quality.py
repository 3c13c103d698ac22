"""Quality classifier: random-indexing word vectors pooled per document, then a calibrated two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import CACHE_WORDS, drop_stored, small, stored

#: Words fall into this many cells; a word vector has this many dimensions.
CELLS, DIMS = 1 << 13, 32
#: A word's context is this many words on either side.
REACH = 2
#: Words that one task adds up at once.
CHUNK = 1 << 17
#: Labelled documents that the network is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Network: hidden units, epochs, batch; parts of ten that calibrate the temperature.
HIDDEN, EPOCHS, BATCH, HELD = 32, 60, 256, 2

#: A word is a run of letters and digits, or of other marks.
_WORD = re.compile(r"\w+|[^\w\s]+")


class Cells(dict):
    """Cell of a word, kept while the worker lives and emptied at a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        cell = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % CELLS
        return cell


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, the same everywhere: four entries of each row are +1 or -1."""
    rng = np.random.default_rng(20240501)
    out = np.zeros((CELLS, DIMS), np.int32)
    for _ in range(4):
        out[np.arange(CELLS), rng.integers(0, DIMS, CELLS)] += rng.choice(np.array([-1, 1], np.int32), CELLS)
    return out


def cells_of(text: str | None, cells: Cells) -> np.ndarray:
    words = _WORD.findall(text or "")
    return np.fromiter(map(cells.__getitem__, words), np.uint16, len(words))


def tokenized(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, cells): the cells of a whole text's words, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for batch in small(batches):
            found = pa.array([cells_of(t, cells).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "cells"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, cells binary")


def word_vectors(tokens: DataFrame) -> np.ndarray:
    """Context vectors from all documents: the sum of the index vectors of a word's neighbours, over all its places.

    Each task adds up its own rows, many texts laid end to end at once; Spark sums the tasks' integers by cell, so the result
    doesn't depend on order. What reaches the driver has a fixed size: a row for each cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.vstack([index_vectors().astype(np.int8), np.zeros((1, DIMS), np.int8)])  # the last one stands between texts
        total, seen = np.zeros((CELLS + 1, DIMS), np.int64), np.zeros(CELLS + 1, np.int64)
        gap = np.full(REACH, CELLS, np.uint16)

        def add(laid: np.ndarray) -> None:
            for low in range(REACH, len(laid) - REACH, CHUNK):
                words = laid[low - REACH : min(len(laid), low + CHUNK + REACH)]  # with their neighbours, so no place is lost
                near, n = index[words], len(words) - 2 * REACH
                around = sum(near[REACH + d : REACH + d + n] for d in range(-REACH, REACH + 1) if d)
                mine = words[REACH : REACH + n]
                order = np.argsort(mine, kind="stable")
                mine = mine[order]
                first = np.flatnonzero(np.diff(mine.astype(np.int32), prepend=-1))
                total[mine[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
                seen[:] += np.bincount(mine, minlength=CELLS + 1)

        for batch in small(batches):
            held, size = [gap], 0
            for b in batch.column(0).to_pylist():
                held += [np.frombuffer(b, "<u2"), gap]
                size += len(b) // 2
                if size > CHUNK:
                    add(np.concatenate(held))
                    held, size = [gap], 0
            add(np.concatenate(held))
        at = np.flatnonzero(seen[:CELLS])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), *[pa.array(total[at, d]) for d in range(DIMS)]], names=["cell", "n", *[f"d{d}" for d in range(DIMS)]])

    columns = [f"d{d}" for d in range(DIMS)]
    parts = tokens.select("cells").mapInArrow(run, "cell int, n long, " + ", ".join(f"{c} long" for c in columns))
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((CELLS, DIMS))
    out[sums["cell"].to_numpy(int)] = sums[columns].to_numpy(float) / sums[["n"]].to_numpy(float)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features_of(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """A row for each text's cells: the mean and the spread of its word vectors, and a few moments of its words."""
    rows = np.zeros((len(texts), 2 * DIMS + 4), np.float32)
    for i, b in enumerate(texts):
        words = np.frombuffer(b, "<u2")
        if len(words):
            found, n = np.unique(words, return_counts=True)
            share, v = (n / len(words)).astype(np.float32), table[found]
            mean = share @ v
            rows[i, :DIMS], rows[i, DIMS : 2 * DIMS] = mean, share @ (v - mean) ** 2
            rows[i, 2 * DIMS :] = np.log1p(len(words)) / 10, len(found) / len(words), share.max(), np.mean(words[1:] == words[:-1]) if len(words) > 1 else 0
    return rows


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """A tanh layer and a logistic one by Adam; the temperature is chosen on rows that the weights haven't seen."""
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if not len(y):
        net.w2[:] = 0  # nothing to learn from: one half
        return net
    parts = rng.integers(0, 10, len(y))
    fit, held = parts >= HELD, parts < HELD
    if len(y) < 40:
        fit = held = np.ones(len(y), bool)
    xs, ys = x[fit], y[fit]
    net.mean, net.scale = xs.mean(axis=0), xs.std(axis=0) + 1e-3
    xs = (xs - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ys))
        for low in range(0, len(ys), BATCH):
            i = order[low : low + BATCH]
            h = np.tanh(xs[i] @ weights[0] + weights[1])
            e = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -50, 50))) - ys[i]) / len(i)
            back = np.outer(e, weights[2]) * (1 - h * h)
            slopes = [xs[i].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ e + 1e-4 * weights[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= 5e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    z, t = net.logits(x[held]), y[held]
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid] if len(t) else [0.0] * len(grid)
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: key, score (probability of label 1, calibrated), and the ``keep`` columns.

    Words share CELLS hashed cells, so a word's vector is its cell's. The vectors come from all documents. The network is fitted on the labelled rows that ``training`` (a condition on
    ``key``) marks, at most ``train_rows`` of those that are in ``docs``, taken by the smallest hash of the key; a key with several labels
    counts as its largest. Null and empty texts have zero features and a score; null keys are scored and never
    learned from; repeated rows are kept (of a repeated key the least features are learned from); without labels every score is one half; other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, key=key, text=text), "quality-tokens")
    table = spark.sparkContext.broadcast(word_vectors(tokens).astype(np.float32))
    marks = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isNotNull() & training)
    marks = marks.groupBy(F.col(key).alias("key")).agg(F.max("y").alias("y")).join(tokens.select("key"), "key", "left_semi").withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(train_rows)  # a few numbers a row

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = features_of(batch.column(3).to_pylist(), table.value)
            features = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], features], names=["key", "y", "h", "features"])

    sample = tokens.select("key", "cells").join(F.broadcast(marks), "key").select("key", "y", "h", "cells").mapInArrow(pooled, "key long, y int, h long, features array<float>")
    sample = sample.groupBy("h", "key", "y").agg(F.min("features").alias("features")).toPandas().sort_values(["h", "key"])
    drop_stored(tokens)
    x = np.array(sample["features"].tolist(), float).reshape(len(sample), 2 * DIMS + 4)
    net = spark.sparkContext.broadcast(fit_network(x, (sample["y"].to_numpy() >= 1).astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for batch in small(batches):
            x = features_of([cells_of(t, cells).tobytes() for t in batch.column(1).to_pylist()], table.value).astype(float)
            texts = batch.columns[1:2] if text in keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.probability(x)), batch.column(2), *texts], names=["key", "score", "rest", "text"][: 3 + len(texts)])

    others = [c for c in keep if c != text]  # a kept text goes through once
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    kind = "key long, score double, rest " + rows.schema["rest"].dataType.simpleString() + (", text string" if text in keep else "")
    scored = rows.mapInArrow(run, kind)
    return scored.select(F.col("key").alias(key), "score", *[(F.col("text") if c == text else F.col("rest")[c]).alias(c) for c in keep])

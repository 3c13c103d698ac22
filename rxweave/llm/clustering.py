"""Centroid clustering of whole-number vectors by Elkan's bounds, with exact distances and exact means.

Every vector carries an upper bound of the distance to its centroid and a lower bound for each of the k centroids. A round
reads them, works out only the distances that the bounds leave open, and writes them anew; rows never leave their task. What
travels is a task's k sums, and what the driver holds is k centroids.

Bounds are doubles rounded to the safe side, and a centroid is skipped only if it is strictly farther, so that a tie always
reaches the exact comparison of whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import drop_stored, stored

#: What one rounded step of a bound may be off, generously.
SLACK = 1e-12
#: Whole-number components stay below this, so that a squared distance of 64 of them is exact in 64 bits.
LARGEST = 1 << 27
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("...i,...i->...", gap, gap)


def nearest(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Bring ``cluster``, ``upper`` and ``lower`` (changed in place) up to date with ``centroids``; ties go to the smaller number.

    Returns how many distances were worked out.
    """
    k = len(centroids)
    half = np.stack([_below(squared(centroids, c)) for c in centroids]) / 2
    np.fill_diagonal(half, np.inf)
    left = np.flatnonzero(upper >= half.min(1)[cluster])  # no other centroid can be as near to the rest
    unsure = (lower[left] <= upper[left, None]) & (half[cluster[left]] <= upper[left, None])
    unsure[np.arange(len(left)), cluster[left]] = False
    left = left[unsure.any(1)]
    own = cluster[left]
    best = squared(x[left], centroids[own])
    bound = _above(best)
    lower[left, own] = _below(best)
    done = len(left)
    for j in range(k):
        at = np.flatnonzero((own != j) & (lower[left, j] <= bound) & (half[own, j] <= bound))
        found = squared(x[left[at]], centroids[j])
        lower[left[at], j] = _below(found)
        nearer = (found < best[at]) | ((found == best[at]) & (j < own[at]))
        to = at[nearer]
        own[to], best[to], bound[to] = j, found[nearer], _above(found[nearer])
        done += len(at)
    cluster[left], upper[left] = own, bound
    return done


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, shift: np.ndarray) -> None:
    """Loosen the bounds (in place) by what each centroid moved."""
    upper += shift[cluster]
    upper *= 1 + SLACK
    lower *= 1 - SLACK
    lower -= shift
    np.maximum(lower, 0, out=lower)


def _vectors(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _first(dims: int):
    """Whole numbers as bytes; every vector starts at centroid 0 and knows nothing yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().astype("<i4").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], _packed(x)], names=["vec_id", "x"])

    return run


def _round(centroids: np.ndarray, shift: np.ndarray | None, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = _vectors(batch["x"], "<i4", dims).astype(np.int64)
            if shift is None:
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster, upper, lower = batch["cluster"].to_numpy().astype(np.int64), batch["upper"].to_numpy().copy(), _vectors(batch["lower"], "<f8", k).copy()
                moved(upper, lower, cluster, shift)
            nearest(x, cluster, upper, lower, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["x"], pa.array(cluster.astype(np.int32)), pa.array(upper), _packed(lower), pa.array(squared(x, centroids[cluster]))],
                names=["vec_id", "x", "cluster", "upper", "lower", "distance"],
            )

    return run


def _sums(k: int, dims: int):
    """A task's count and componentwise sum of each of its clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch["cluster"].to_numpy()
                np.add.at(total, cluster, _vectors(batch["x"], "<i4", dims))
                count += np.bincount(cluster, minlength=k)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every component, exact; a centroid without vectors stays. The driver gets k times ``dims`` sums."""
    k, dims = centroids.shape
    parts = state.select("cluster", "x").mapInArrow(_sums(k, dims), "cluster int, n bigint, total array<bigint>")
    wide = "decimal(38,0)"
    sums = parts.select("cluster", F.col("n").cast(wide).alias("n"), F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").cast(wide).alias("n"), F.sum(F.col("s").cast(wide)).cast(wide).alias("s"))
    new = centroids.copy()
    for r in sums.collect():
        new[r["cluster"], r["i"]] = int(r["s"]) // int(r["n"])
    return new


def cluster_vectors(vectors: DataFrame, *, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Cluster column ``embedding`` of ``vectors`` (id column ``vec_id``): a row of RESULT for each vector that takes part.

    A vector takes part if it has exactly ``dims`` components, none null or non-finite; each becomes floor(scale * x), and
    one of LARGEST or more is an error, since its distances don't fit. The first centroids are the ``k`` vectors with the
    smallest sha256 of ``seed:vec_id`` (a null id is written as nothing; equal hashes: smaller vector first), all if there
    are fewer. ``rounds`` times every vector goes to the nearest centroid (squared Euclidean distance, ties to the smaller
    number) and every centroid with vectors to their componentwise floor of the mean; then vectors are assigned once more.
    Repeated rows count as often as they are there, other columns are left out, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.size("embedding") == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(e, lambda v: F.when(F.abs(v * scale) < LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint")))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids, shift = np.array([r["x"] for r in first], np.int64), None
    state = kept.mapInArrow(_first(dims), "vec_id bigint, x binary")
    for n in range(rounds + 1):
        old, state = state, state.mapInArrow(_round(centroids, shift, dims), "vec_id bigint, x binary, cluster int, upper double, lower binary, distance bigint")
        if n == rounds:
            state = state.select("vec_id", "cluster", "distance")
        state = stored(state, f"clusters{n}")
        if n:
            drop_stored(old)
        if n < rounds:
            new = _means(state, centroids)
            centroids, shift = new, _above(squared(new, centroids))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # k rows at most, here and on the driver
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return state.select(
        "vec_id", "cluster", "distance", of([inertia.get(j, 0) for j in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of(digests).alias("centroid_sha256"),
    )

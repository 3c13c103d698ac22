"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxweave.llm.common import small, stored

#: Rows that the codebooks are fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 8192
#: Codebooks, entries of each, and codes that beam search keeps.
BOOKS, ENTRIES, BEAM = 8, 256, 4
#: Rows of a cell, and queries that visit it, that one task takes at once.
ROWS, QUERIES = 16_384, 1024
#: Pairs of a query and a row that are scored at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """``books``: (BOOKS, ENTRIES, dims); a vector is near the sum of one entry of each."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the full-dimensional books, and the squared norms of the sums they stand for."""
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        norms = np.zeros(len(x))
        for low in range(0, len(x), 1024):
            part = x[low : low + 1024]
            left = part[:, None, :]  # residuals of the beam
            kept = np.zeros((len(part), 1, 0), np.uint8)
            for book in self.books:
                cost = (left**2).sum(-1)[:, :, None] - 2 * left @ book.T + (book**2).sum(-1)
                width = cost.shape[2]
                flat = cost.reshape(len(part), -1)
                best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                parent, entry = best // width, best % width
                rows = np.arange(len(part))[:, None]
                kept = np.concatenate([kept[rows, parent], entry[:, :, None].astype(np.uint8)], axis=2)
                left = left[rows, parent] - book[entry]
            codes[low : low + 1024] = kept[:, 0]
            norms[low : low + 1024] = ((part - left[:, 0]) ** 2).sum(-1)
        return codes, norms


def train(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 5) -> Codebooks:
    """Residual k-means: each book is fitted to what the books before it leave."""
    rng, left, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        k = min(entries, len(left))
        centres = left[rng.choice(len(left), k, replace=False)].copy() if k else np.zeros((1, x.shape[1]))
        for _ in range(rounds if k else 0):
            near = np.argmin((centres**2).sum(-1) - 2 * left @ centres.T, axis=1)
            n = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, left)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if len(left):
            left -= centres[np.argmin((centres**2).sum(-1) - 2 * left @ centres.T, axis=1)]
        out.append(np.vstack([centres, np.zeros((max(0, entries - len(centres)), x.shape[1]))]))
    return Codebooks(np.array(out))


def index(vectors: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """Every row beside its vector: its codes (a byte for each book), the norm they stand for, the quantisation error, its cell
    (the first code) and its distance from the cell's centre: key, vec, codes, norm, err, cell, far."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            codes, norms = shared.value.encode(x)
            err = np.sqrt(((x - sum(book[codes[:, b]] for b, book in enumerate(shared.value.books))) ** 2).sum(-1))
            far = np.sqrt(((x - shared.value.books[0][codes[:, 0]]) ** 2).sum(-1))
            columns = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(err), pa.array(codes[:, 0].astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vec", "codes", "norm", "err", "cell", "far"])

    return vectors.mapInArrow(run, "key long, vec array<double>, codes binary, norm double, err double, cell int, far double")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x and q, with the squares added up from the first component to the last."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])


def _pairs_within(table: np.ndarray, codes: np.ndarray, limit: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs whose ``limit`` is at most twice the sum of the query's table entries for the row's codes."""
    sums = np.zeros((len(table), rows))
    for b in range(len(codes)):
        sums += table[:, b, codes[b]]
    return np.nonzero(2 * sums >= limit)


def _first_copies(x: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest keys of each distinct vector: further copies can't be among the n nearest."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((keys, group))
    at = np.arange(len(keys)) - np.searchsorted(group[order], group[order])
    return np.sort(order[at < n])


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec")).where("key is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 100, n: int = 10, *, key: str = "vec_id", vector: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """The n nearest rows of each query, by Euclidean distance: query_id, rank, key, score.

    Queries are the rows whose key is divisible by ``every``; candidates are all rows with another key. Codebooks are fitted
    on at most TRAIN_ROWS rows; every row is encoded and indexed, in the cell of its first code.

    A query's n-th distance to the rows of that sample bounds its n-th distance to all rows. It visits the cells that a row
    within the bound can lie in (centre distance less the cell's radius). There its lookup table of inner products with the
    entries scores a row as its stored norm less twice the entries' sum, and every row whose table distance less its
    stored quantisation error is within the bound is reranked exactly, in double precision on the original vectors, with
    ties by the smaller key. The bounds leave out only rows that can't be among the n nearest, so the result is exact and
    doesn't depend on batches or partitions.

    Rows and queries meet in a join on the cell. A cell of many rows is dealt out by ``rows``, one that many queries visit by
    ``queries``, so a task holds at most about so many of each. The driver sees the sample and a row for each cell.

    Rows whose key is null, or whose vector is null, zero, empty, of another length than most valid rows have (the
    longer of two as common), or holds nulls or non-finite numbers, take no part. Repeated keys are candidates (and, as queries, one) each; other
    columns are ignored; without two valid keys there are no rows.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors, key, vector)
    result = "query_id long, rank int, {} long, score double".format(key)
    commonest = valid.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None:
        return spark.createDataFrame([], result)
    dims = commonest["dims"]
    valid = valid.where(F.size("vec") == dims)
    sample = valid.withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(TRAIN_ROWS).toPandas()
    known = sample["key"].to_numpy(), np.array(sample["vec"].tolist(), float)
    fitted = train(known[1])
    indexed = stored(index(valid, fitted, dims), "ann-index")
    cells = {r.cell: (r.radius, r.n) for r in indexed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each entry of a book
    books, seen = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast((known, {c: r for c, (r, _) in cells.items()}))
    asked = indexed.where(F.col("key") % every == 0).groupBy("key").agg(F.min("vec").alias("vec"))
    asked = stored(asked.mapInArrow(_planner(books, seen, dims, n), "query_id long, q array<double>, most double, cell int"), "ann-queries")
    visits = dict(map(tuple, asked.groupBy("cell").count().collect()))
    if not visits:
        return spark.createDataFrame([], result)
    sizes = spark.createDataFrame([(c, 1 + cells[c][1] // rows, 1 + m // queries) for c, m in visits.items()], "cell int, deals int, turns int")
    left = indexed.drop("far").join(F.broadcast(sizes), "cell").withColumn("deal", F.pmod(F.xxhash64("key", "vec"), F.col("deals")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = asked.join(F.broadcast(sizes), "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    group = ["cell", "deal", "turn"]
    left, right = left.select(*group, "key", "vec", "codes", "norm", "err"), right.select(*group, "query_id", "q", "most")
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_scorer(books, dims, n), "query_id long, key long, score double")
    near = Window.partitionBy("query_id").orderBy("score", "key")
    return met.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n).select("query_id", "rank", F.col("key").alias(key), "score")


def _planner(books, seen, dims: int, n: int):
    """The cells that each query must visit, and the distance beyond which no row can be among its n nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, x), radius = seen.value
        cells = np.array(sorted(radius), np.int64)
        centres, radii = books.value.books[0][cells], np.array([radius[c] for c in cells.tolist()])
        norms, centre_norms = (x**2).sum(-1), (centres**2).sum(-1)
        for batch in small(batches, 256):
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            size = (q**2).sum(-1)[:, None]
            rounding = 1e-9 * (size[:, 0] + norms.max())  # above what rounding does to a difference of squares
            square = size - 2 * q @ x.T + norms
            square[ids[:, None] == keys] = np.inf
            if len(keys) >= n:
                most = np.sqrt(np.maximum(np.partition(square, n - 1, axis=1)[:, n - 1], 0) + rounding)
            else:
                most = np.full(len(ids), np.inf)
            away = np.sqrt(np.maximum(size - 2 * q @ centres.T + centre_norms - rounding[:, None], 0))
            at, to = np.nonzero(away * (1 - 1e-9) <= most[:, None] + radii)
            some = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(most[at]), pa.array(cells[to].astype(np.int32))], names=["query_id", "q", "most", "cell"])

    return run


def _scorer(books, dims: int, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            keys, x = left.column("key").to_numpy(), _matrix(left.column("vec").combine_chunks(), dims)
            norms, err = left.column("norm").to_numpy(), left.column("err").to_numpy()
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(keys), -1)
            some = _first_copies(x, keys, n + 1)  # one may be the query itself
            keys, x, norms, err, codes = keys[some], x[some], norms[some], err[some], codes[some].T.copy()
            ids, queries, most = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks(), dims), right.column("most").to_numpy()
            size = (queries**2).sum(-1)
            step = max(1, PAIRS // len(keys))
            for low in range(0, len(ids), step):
                part = slice(low, low + step)
                table = np.einsum("qd,bed->qbe", queries[part], books.value.books, optimize=True)
                # the table distance less the error is within the bound; the slack is above what rounding does to a difference of squares
                reach = most[part, None] + err + 1e-6 * np.sqrt(size[part, None] + norms)
                i, r = _pairs_within(table, codes, norms + size[part, None] - reach**2, len(keys))
                differ = ids[part][i] != keys[r]
                i, r = i[differ], r[differ]
                score = np.concatenate([np.zeros(0), *[distances(x[r[k : k + 50_000]], queries[part][i[k : k + 50_000]]) for k in range(0, len(r), 50_000)]])
                order = np.lexsort((keys[r], score, i))
                i, r, score = i[order], r[order], score[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < n
                found.append((ids[part][i[top]], keys[r[top]], score[top]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "key", "score"), columns, strict=True)))

    return run

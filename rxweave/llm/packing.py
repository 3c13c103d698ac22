"""Pattern packing: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxweave.llm.common import small, stored

#: Rows that share a length and a bucket are numbered by one task; the number of buckets follows the rows.
BUCKET_ROWS = 2000
#: Triples tried for each length, and rounds of the least-squares fit.
TRIPLES, ROUNDS = 24, 400


def _bytes_of_characters() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, from a byte-level BPE vocabulary (a tokenizers JSON file).

    The vocabulary's special strings in a text are their ids, and the texts between them are encoded on their own, as
    tokenizers does it. A text without them is encoded whole, in one call: words that are kept and looked up cost more, since
    half of the different words of a corpus come once.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        spelled = _bytes_of_characters()
        ranks = {bytes(map(spelled.__getitem__, token)): n for token, n in made["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {s: np.array([n], "<u4").tobytes() for s, n in special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self.whole(part) for part in self.marks.split(text) if part)
        return self.whole(text)


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One for each worker, as long as it lives."""
    return Encoder(path, pattern)


def tokenized(docs: DataFrame, path: str, pattern: str, size: int, end: int, with_ids: bool, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens: key, piece, start, length, ids_crc32 (and ids). The first may be shorter."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for batch in small(batches):
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encoder.encode(t) if t else b"") + last
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for piece, start in enumerate([0, *range(first, n, size)]):
                    length = first if piece == 0 else size
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((k, piece, start, length, zlib.crc32(part), part))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["key", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 5 + with_ids], names=names[: 5 + with_ids])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns_of(histogram: Mapping[int, int], size: int) -> list[tuple[int, ...]]:
    """Full patterns of one, two and three lengths (longest first), from the lengths that occur."""
    have = np.array(sorted(histogram), int)
    present = np.zeros(size + 1, bool)
    present[have] = True
    found: set[tuple[int, ...]] = {(size,)} if present[size] else set()
    for a in have[::-1]:
        a = int(a)
        if present[size - a] and 2 * a >= size:
            found.add((a, size - a) if a < size else (a,))
        rest = size - a
        seconds = have[(have <= min(a, rest)) & (have >= (rest + 1) // 2)]
        seconds = seconds[present[rest - seconds] & (rest - seconds > 0)]
        if len(seconds) > TRIPLES:
            seconds = seconds[np.linspace(0, len(seconds) - 1, TRIPLES).astype(int)]
        found.update((a, int(b), rest - int(b)) for b in seconds)
    return sorted(found, reverse=True)


def fitted_counts(patterns: list[tuple[int, ...]], histogram: Mapping[int, int], size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that lower |A x - h|: multiplicative updates of non-negative least squares."""
    width = max(map(len, patterns), default=0)
    cells = np.array([[*p, *[0] * (width - len(p))] for p in patterns], int).reshape(len(patterns), width)
    h = np.zeros(size + 1)
    h[list(histogram)] = list(histogram.values())
    real = cells > 0
    x = np.maximum((h[cells] * real + (~real) * 1e18).min(axis=1), 1e-9) if len(patterns) else np.zeros(0)
    goal = (h[cells] * real).sum(axis=1)
    for _ in range(rounds if len(patterns) else 0):
        made = np.bincount(cells[real], weights=np.repeat(x, real.sum(axis=1)), minlength=size + 1)
        x *= goal / np.maximum((made[cells] * real).sum(axis=1), 1e-12)
    return x


def best_fit(histogram: Mapping[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts of lengths: groups of equal bins are filled together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free tokens
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = min((f for f in groups if f >= length and groups[f]), default=None)
            if free is None:
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    groups[size - each * length].append(((length,) * each, full))
                if rest:
                    groups[size - rest * length].append(((length,) * rest, 1))
                break
            held, n = groups[free].pop()
            take = min(n, left)
            if n > take:
                groups[free].append((held, n - take))
            groups[free - length].append(((*held, length), take))
            left -= take
    return [g for of in groups.values() for g in of]


def plan_of(histogram: Mapping[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), using every piece of the histogram once.

    Work and memory follow the number of distinct lengths, which ``size`` bounds, not the number of documents.
    """
    left = Counter(histogram)
    patterns = patterns_of(histogram, size)
    counts = fitted_counts(patterns, histogram, size)
    plan: list[tuple[tuple[int, ...], int]] = []
    for n in np.argsort(-counts, kind="stable"):
        uses = Counter(patterns[n])
        times = min(int(round(counts[n])), *(left[k] // v for k, v in uses.items()))
        if times > 0:
            plan.append((patterns[n], times))
            left.subtract({k: v * times for k, v in uses.items()})
    return plan + best_fit({k: v for k, v in left.items() if v > 0}, size)


def intervals_of(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first ordinal, first sequence, offset): the pieces of a length fill its intervals in order."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, pattern: str, *, size: int = 2048, end: int = 0, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end``. Longer ones are cut into pieces of ``size``, the first shorter.
    ``with_ids`` adds the ids (unsigned 32-bit, little-endian), so a sequence is its pieces' ids by offset. ``path`` is a
    byte-level vocabulary as a tokenizers JSON file, ``pattern`` its pre-token pattern.

    The pieces are written once. Their histogram of lengths (at most ``size`` rows) is the only thing the driver sees; it
    makes the plan. A piece's ordinal among those of its length comes from counts of hash buckets, whose number
    follows the rows, plus its place in its bucket, so a very common length is dealt out too. Each ordinal falls into an
    interval of the plan, whose size follows the number of lengths.

    Null or empty text is ``end`` alone; null keys and repeated rows are packed like any other; an empty table
    gives no rows; other columns are ignored.
    """
    pieces = stored(tokenized(docs, path, pattern, size, end, with_ids, key=key, text=text), "pieces")
    histogram = dict(map(tuple, pieces.groupBy("length").count().collect()))
    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    mine = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mine.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32")
    ranked = mine.withColumn("n", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("n") - 1).alias("ordinal"))
    plan = pieces.sparkSession.sparkContext.broadcast(intervals_of(plan_of(histogram, size)))
    at = pieces.columns.index("length")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        codes = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, batch.num_columns - 1))
            row = table[np.searchsorted(codes, (length << 44) + ordinal, side="right") - 1] if len(length) else table[:0]
            sequence, offset = row[:, 2] + ordinal - row[:, 1], row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = "key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(placed, kind).withColumnRenamed("key", key)

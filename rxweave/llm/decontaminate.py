"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import Hashes, small, stored

#: An overlap: in every window of this many words of the item, this share of the words is equal.
WINDOW, SHARE = 13, 0.8
#: Bits of the table that tells training tasks which hashes the benchmark has: cells for each seed, those that are set for one, and
#: the least and the largest size (powers of two; the largest is 32 MB). About one other hash in a million passes.
CELLS_A_SEED, PROBES, LEAST_LOG, MOST_LOG = 128, 4, 16, 28
#: Words that one task hashes at once.
CHUNK = 1 << 17

#: Bytes outside words become spaces (texts are lower-cased before).
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Stands between texts and past their ends; no word's hash.
GAP = np.uint64(0x9E6C63D0676A9A99)


def need_of(length: int, share: float = SHARE) -> int:
    """Words of ``length`` that must be equal."""
    return max(1, ceil(share * length - 1e-9))


def masks_of(length: int, wrong: int) -> list[str]:
    """Masks of ``length`` places (1 counts, 0 is ignored), so that any ``wrong`` places are ignored by one of them.

    Places fall into ``wrong + 2`` classes by their remainder, and each mask ignores ``wrong`` classes whole. So an
    overlap with at most ``wrong`` other words always agrees with one mask.
    """
    if not wrong:
        return ["1" * length]
    classes = wrong + 2
    masks = ["".join("0" if i % classes in out else "1" for i in range(length)) for out in combinations(range(classes), wrong)]
    return list(dict.fromkeys(m for m in masks if "1" in m))


def masks_for(words: int, window: int = WINDOW, share: float = SHARE) -> list[str]:
    """The masks that seed an item of so many words; a short item is one window as a whole."""
    length = min(words, window)
    return masks_of(length, length - need_of(length, share)) if length else []


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask at every place where it fits: the counted words' hashes, each times an odd factor, summed."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += words[i : i + n] * np.uint64(xxhash.xxh64_intdigest(f"{mask}:{i}") | 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def words_of(text: str | None, known: Hashes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").translate(FOLD).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of benchmark items."""
    known = Hashes()
    for batch in batches:
        words = pa.array([words_of(t, known).view(np.int64).tolist() for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["iid", "item", "words"])


def _seeds(window: int, share: float):
    """The hashes of an item's windows under each of its masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array(words, np.int64).view(np.uint64)
                for mask in masks_for(len(w), window, share):
                    rows += [(item, mask, h, i) for i, h in enumerate(seed_hashes(w, mask).view(np.int64).tolist())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["iid", "mask", "hash", "place"])

    return run


_PROBE_FACTORS = [np.uint64(xxhash.xxh64_intdigest(f"probe{n}") | 1) for n in range(PROBES)]


class BitTable:
    """Which hashes may be in the benchmark: PROBES cells for each, in words of 64 bits."""

    def __init__(self, log: int, words: np.ndarray) -> None:
        self.log, self.words = log, words

    @staticmethod
    def cells(hashes: np.ndarray, probe: int, log: int) -> np.ndarray:
        return (hashes * _PROBE_FACTORS[probe]) >> np.uint64(64 - log)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be in it."""
        some = np.arange(len(hashes))
        for probe in range(PROBES):
            cells = self.cells(hashes[some] if probe else hashes, probe, self.log)
            some = some[(self.words[(cells >> np.uint64(6)).astype(np.int64)] >> (cells & np.uint64(63))) & np.uint64(1) == 1]
        return some


def bit_table(seeds: DataFrame) -> BitTable:
    """Made by Spark: cells are or-ed into words by their place. The driver gets at most 2 ** (MOST_LOG - 6) words."""
    log = int(np.clip(int(seeds.count() * CELLS_A_SEED).bit_length(), LEAST_LOG, MOST_LOG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            cells = np.concatenate([BitTable.cells(hashes, probe, log) for probe in range(PROBES)])
            bits = (np.uint64(1) << (cells & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((cells >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["w", "b"])

    words = seeds.select("hash").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (log - 6), np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return BitTable(log, table.view(np.uint64))


def _regions(table, masks: list[str], reach: int):
    """Where a text may meet the benchmark: the seeds found, and the words as far around them as an item can reach.

    Texts are laid end to end, with a gap as long as a mask between them, and hashed together; a mask may lie partly in the gap
    where it ignores a word, so an overlap that the text's end cuts short is seeded too. A very long text is taken in parts
    that overlap by a mask.
    """
    span = max(map(len, masks), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gap = Hashes(), np.full(span, GAP)
        kind = pa.list_(pa.struct([("mask", pa.string()), ("hash", pa.int64()), ("at", pa.int32())]))

        def found(texts: list[np.ndarray]) -> list[list[dict]]:
            """The seeds of each text."""
            laid = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
            starts = np.cumsum([span] + [len(t) + span for t in texts])
            out: list[list[dict]] = [[] for _ in texts]
            for low in range(0, len(laid), CHUNK):
                part = laid[low : low + CHUNK + span]
                for mask in masks:
                    hashes = seed_hashes(part, mask)[:CHUNK]
                    some = table.value.find(hashes)
                    # a seed belongs to the text that its counted words lie in: the last one that starts before its last word
                    owner = np.searchsorted(starts, some + low + mask.rindex("1"), side="right") - 1
                    for i, o, h in zip((some + low).tolist(), owner.tolist(), hashes[some].view(np.int64).tolist(), strict=True):
                        if 0 <= o < len(texts):
                            out[o].append({"mask": mask, "hash": h, "at": i - int(starts[o])})
            return out

        def rows(held: list[tuple]) -> pa.RecordBatch:
            keys, lows, around, seeds = [], [], [], []
            for (key, th, words), hits in zip(held, found([w for _, _, w in held]), strict=True):
                hits.sort(key=lambda h: h["at"])
                first = 0
                for n in range(1, len(hits) + 1):
                    if n == len(hits) or hits[n]["at"] - max(0, hits[n - 1]["at"]) > reach:  # so no two regions start alike
                        low = max(0, hits[first]["at"] - reach)
                        keys.append((key, th))
                        lows.append(low)
                        around.append(words[low : max(0, hits[n - 1]["at"] + reach + span)].view(np.int64))
                        seeds.append(hits[first:n])
                        first = n
            arrays = [pa.array([k for k, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.int64()), pa.array(lows, pa.int32()), pa.array(around, pa.list_(pa.int64())), pa.array(seeds, kind)]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "th", "low", "around", "hits"])

        for batch in small(batches):
            held, size = [], 0
            for k, th, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append((k, th, words_of(t, known)))
                size += len(held[-1][2])
                if size > CHUNK:
                    yield rows(held)
                    held, size = [], 0
            yield rows(held)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE, window: int = WINDOW) -> DataFrame:
    """Overlaps of training texts with benchmark items: key, item, n_words (of the item that the overlap covers),
    n_equal, first_word, last_word (of the text), text_hash (Spark's xxhash64 of the text), one row for each pair with one.

    Words are runs of letters and digits, lower-cased. Item and text are laid side by side without gaps; a stretch whose
    every window of ``window`` words of the item agrees in at least ``share`` of them is an overlap (so single words may
    be replaced, and words past the text's ends count as other ones); it starts and ends with an equal word. An item
    shorter than a window must agree in that share as a whole. Of several overlaps the one with the most equal words
    counts, then the first. Every such overlap is found: masks are chosen so that whichever words of a window are
    replaced, within the share, one mask ignores them all (see ``masks_of``).

    Training tasks first look hashes up in a bit table made from the benchmark (at most 32 MB), so only the regions around
    hits leave them; the join is an ordinary one on (mask, hash), and neither side need be small. A seed or an item that
    very many texts hold is split by Spark's skew join, and a region's hits with an item on one diagonal are one row.

    Null texts, and texts and items without a word, have no overlaps. Null keys and null items are kept: their rows are told
    apart by their texts. Rows with equal key and text count as one, and so do equal items; rows with equal keys and
    different texts have a row each. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    items = items.select(F.xxhash64("item", "text").alias("iid"), "item", "text").mapInArrow(_items, "iid long, item long, words array<long>")
    items = stored(items.where(F.size("words") > 0), "benchmark-words")
    seeds = stored(items.select("iid", "words").mapInArrow(_seeds(window, share), "iid long, mask string, hash long, place int").distinct(), "benchmark-seeds")
    table = spark.sparkContext.broadcast(bit_table(seeds))
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]  # at most ``window`` numbers
    masks = list(dict.fromkeys(m for n in sorted(lengths) for m in masks_for(n, window, share)))
    reach = int(items.agg(F.max(F.size("words"))).first()[0] or 0) + window
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null").select("key", F.xxhash64("text").alias("th"), "text")
    kind = "key long, th long, low int, around array<long>, hits array<struct<mask:string,hash:long,at:int>>"
    regions = rows.mapInArrow(_regions(table, masks, reach), kind) if masks else rows.limit(0).mapInArrow(_regions(table, ["1"], 1), kind)
    regions = stored(regions.withColumn("region", F.xxhash64("key", "th", "low")).dropDuplicates(["region"]), "benchmark-regions")
    hits = regions.select("region", "low", F.explode("hits").alias("h")).select("region", "low", "h.*")
    pairs = hits.join(seeds, ["mask", "hash"]).select("region", "iid", (F.col("at") - F.col("place") - F.col("low")).alias("shift")).distinct()
    laid = pairs.join(regions.drop("hits"), "region").join(items, "iid").select("key", "th", "item", "iid", "shift", "low", "around", "words")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "th", "item", "iid", "n_words", "n_equal", "first_word", "last_word"]
        for batch in batches:
            out = []
            for k, th, n, iid, shift, low, around, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                span = stretch(np.array(words, np.int64), np.array(around, np.int64), shift, window, share)
                if span:
                    out.append((k, th, n, iid, span[1] - span[0], span[2], low + shift + span[0], low + shift + span[1] - 1))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    spans = laid.mapInArrow(checked, "key long, th long, item long, iid long, n_words long, n_equal long, first_word long, last_word long")
    best = F.max_by(F.struct("n_words", "n_equal", "first_word", "last_word"), F.struct("n_equal", F.negative("first_word"), "n_words")).alias("v")
    found = spans.groupBy("key", "th", "item", "iid").agg(best)
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "v.*", F.col("th").alias("text_hash"))


def stretch(item: np.ndarray, around: np.ndarray, shift: int, window: int, share: float) -> tuple[int, int, int] | None:
    """(first, end, equal words) of the overlap on a diagonal: the one with the most equal words, then the first. In places of
    the item; item word i faces around[i + shift]."""
    places = np.arange(len(item)) + shift
    inside = (places >= 0) & (places < len(around))
    same = np.zeros(len(item), bool)
    same[inside] = item[inside] == around[places[inside]]
    size = min(window, len(item))
    sums = np.concatenate([[0], np.cumsum(same)])
    good = (sums[size:] - sums[:-size]) >= need_of(size, share)
    best = None
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        equal = np.flatnonzero(same[first : last - 1 + size]) + first
        if best is None or len(equal) > best[2]:
            best = int(equal[0]), int(equal[-1]) + 1, len(equal)
    return best

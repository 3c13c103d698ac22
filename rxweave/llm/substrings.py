"""Repeated byte strings across a corpus: suffixes are sorted in two stages, and neighbours in that order are compared.

Only text that can repeat is sorted. Each window of SPAN bytes belongs to the smallest hash of the grams (64 bytes) inside it,
its key, so equal windows have one key wherever they stand; neighbouring windows of one key make a piece. A key whose
gram was seen once holds no repeat and goes, which leaves the text that is shared. Equal pieces are put together with their
number, and the pieces of a key meet in one task, many keys at a time: suffixes smaller than their successors are sorted
directly, the others are induced from them by a scan of the buckets, and two windows are equal if neighbours in the order
have a common prefix of SPAN bytes.

A key with more than GROUP different pieces (a passage inside a large part of the corpus, with other text around each place)
is too much for a task: its windows are told apart one by one, by 128-bit hashes, which are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import drop_stored, stored

#: Bytes of a gram: 2 ** 6.
DOUBLINGS = 6
GRAM = 1 << DOUBLINGS
#: Windows of a piece at most, and windows of a text that are looked at at a time.
PIECE, AT_A_TIME = 1024, 1 << 20
#: Different pieces of a key that one task takes, and bytes that it sorts at a time.
GROUP, SORTED = 2000, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
SPANS = "array<struct<a:bigint,b:bigint>>"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place: the hash of 2n bytes comes from those of its halves."""
    h, step = data.astype(np.uint64), 1
    for _ in range(DOUBLINGS):
        h = h[:-step] * _A + h[step:]
        h ^= h >> _SHIFT
        h *= _B
        step *= 2
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces_of(text: bytes, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, windows, key, grams) of each piece; grams counts the places of the key's gram in it."""
    for low in range(0, len(text) - span + 1, AT_A_TIME):
        h = gram_hashes(np.frombuffer(text[low : low + AT_A_TIME + span - 1], np.uint8))
        keys = sliding_least(h, span - GRAM + 1)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            for start in range(a, b, PIECE):
                n = min(PIECE, b - start)
                grams = int(np.count_nonzero(h[start : start + n + span - GRAM] == keys[a]))
                yield low + start, n, int(keys[a].view(np.int64)), grams


def _pieces(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, node, text in zip(batch["doc_id"].to_pylist(), batch["node"].to_pylist(), batch["text"], strict=True):
                data = text.as_py().encode()
                rows += ((doc_id, node, s, n, k, xxhash.xxh3_128_digest(data[s : s + n + span - 1]), g) for s, n, k, g in pieces_of(data, span))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "node", "start", "windows", "key", "piece", "grams"])

    return run


# -- the order of suffixes


def suffix_order(pieces: Sequence[bytes], span: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as one text, where each begins in it, how many windows each has, and the places of all windows in the order of
    their suffixes, which is right in the first ``span`` bytes. A suffix ends with its piece."""
    text = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins, counts = ends - sizes, sizes - span + 1
    data, n = np.frombuffer(text, np.uint8), len(text)
    of = np.repeat(np.arange(len(pieces)), sizes)
    # a suffix is smaller than its successor if the first byte that differs from the next one is smaller; at a piece's end it is larger
    after = np.append(data[1:], 0).astype(np.int16)
    after[ends - 1] = -1
    differs = after != data
    place = np.where(differs, np.arange(n), n)
    decides = np.minimum.accumulate(place[::-1])[::-1]
    smaller = (data < after)[decides]
    # suffixes that are needed: the windows, and what follows them up to one that is sorted directly
    at = np.arange(n)
    direct = np.where(smaller & (at >= (begins + counts)[of]), at, n)
    stop = np.minimum(np.minimum.reduceat(direct, begins), ends - 1)
    first = np.flatnonzero(smaller & (at <= stop[of]))
    limit = np.minimum(first + span, ends[of[first]])
    keys = [text[i:j] for i, j in zip(first.tolist(), limit.tolist(), strict=True)]
    direct_order = first[sorted(range(len(first)), key=keys.__getitem__)]
    cuts = np.searchsorted(data[direct_order], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(places: np.ndarray, c: int) -> np.ndarray:
        """Put the larger suffixes right before ``places`` at the heads of their buckets; those of bucket ``c`` itself come back."""
        before = places[places > begins[of[places]]] - 1
        before = before[~smaller[before]]
        deal(before[data[before] != c])
        return before[data[before] == c]

    def deal(places: np.ndarray) -> None:
        if not len(places):
            return
        places = places[np.argsort(data[places], kind="stable")]
        letters, starts = np.unique(data[places], return_index=True)
        for letter, part in zip(letters.tolist(), np.split(places, starts[1:]), strict=True):
            buckets[letter].append(part)

    whole = stop[~smaller[stop]]  # pieces that end without a suffix to start from: their last suffix is induced by the end
    deal(whole)
    order: list[np.ndarray] = []
    for c in range(256):
        if buckets[c]:
            wave = np.concatenate(buckets[c])
            while len(wave):
                order.append(wave)
                wave = induce(wave, c)
        direct_part = direct_order[cuts[c] : cuts[c + 1]]
        if len(direct_part):
            order.append(direct_part)
            induce(direct_part, -1)
    places = np.concatenate(order) if order else np.zeros(0, np.int64)
    return text, begins, counts, places[places < (begins + counts)[of[places]]]


def repeated_windows(pieces: Sequence[bytes], span: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs (from, to) of its windows that stand at another place too, in it or in another piece."""
    text, begins, counts, order = suffix_order(pieces, span)
    places = order.tolist()
    same = np.fromiter((text[i : i + span] == text[j : j + span] for i, j in zip(places, places[1:], strict=False)), bool, max(len(places) - 1, 0))
    found = np.zeros(len(text) + 1, bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    runs = []
    for begin, n in zip(begins.tolist(), counts.tolist(), strict=True):
        edges = np.flatnonzero(np.diff(found[begin : begin + n].astype(np.int8), prepend=0, append=0)).tolist()
        runs.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return runs


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _sorted_groups(span: int):
    """Rows come in the order of their keys; whole keys are sorted together, about SORTED bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            runs = repeated_windows([r[3] for r in held], span)
            rows = [(k, p, [{"a": a, "b": b} for a, b in found]) for (k, p, weight, _), found in zip(held, runs, strict=True) if weight == 1 and found]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], _RUNS)], names=["key", "piece", "runs"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "piece", "weight", "data")), strict=True):
                if row[0] != last and size >= SORTED:
                    yield out()
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue  # rows that are there several times, id and text
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield out()

    return run


def _windows(span: int):
    """A row for each window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, piece, weight, data in zip(*(batch[c].to_pylist() for c in ("key", "piece", "weight", "data")), strict=True):
                hashes = [xxhash.xxh3_128_digest(data[i : i + span]) for i in range(len(data) - span + 1)]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([key] * n, pa.int64()), pa.array([piece] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([weight] * n, pa.int64())], names=["hash", "key", "piece", "a", "weight"])

    return run


def _cut(span: int):
    """The bytes of the pieces that a text stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data, pieces = text.as_py().encode(), wanted.as_py()
                columns = [pa.array([p[c] for p in pieces], k) for c, k in (("key", pa.int64()), ("piece", pa.binary()), ("weight", pa.int64()), ("hot", pa.bool_()))]
                columns.append(pa.array([data[p["start"] : p["start"] + p["windows"] + span - 1] for p in pieces], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "weight", "hot", "data"])

    return run


def merged(runs: Sequence[dict], span: int) -> list[tuple[int, int]]:
    """Runs of windows as disjoint spans of bytes, in order."""
    spans: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + span - 1) for r in runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _removed(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"], strict=True):
                data, spans = (text.as_py() or "").encode(), merged(runs.as_py() or (), span)
                left, at = hashlib.sha256(), 0
                for a, b in spans:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                rows.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), left.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _RUNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, span: int) -> DataFrame:
    """(node, runs): for each text with repeats (``node`` is its MD5) the runs of its windows that stand at another place too.

    ``docs`` has doc_id, text (of ``span`` bytes or more) and node.
    """
    found = stored(docs.mapInArrow(_pieces(span), "doc_id bigint, node binary, start bigint, windows int, key bigint, piece binary, grams int"), "pieces")
    seen = found.groupBy("key").agg(F.sum("grams").alias("n")).where("n > 1").select("key")
    shared = stored(found.join(seen, "key", "left_semi"), "shared-pieces")
    drop_stored(found)
    rep = F.min(F.struct("doc_id", "node", "start")).alias("rep")
    each = stored(shared.groupBy("key", "piece").agg(F.count("*").alias("weight"), rep, F.max("windows").alias("windows"), F.max("grams").alias("grams")), "different-pieces")
    per_key = each.groupBy("key").agg(F.count("*").alias("different"), F.max("grams").alias("most"))
    # a piece alone in its key, with the gram once, is repeated if it is there twice; the others are sorted
    open_keys = per_key.where("different > 1 OR most > 1").select("key", (F.col("different") > GROUP).alias("hot"))
    wanted = each.join(open_keys, "key").select("rep.doc_id", "rep.node", F.struct("rep.start", "windows", "key", "piece", "weight", "hot").alias("w"))
    wanted = wanted.groupBy("doc_id", "node").agg(F.collect_list("w").alias("wanted")).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "wanted")
    cut = docs.join(wanted, F.col("node").eqNullSafe(F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "wanted")
    cut = stored(cut.mapInArrow(_cut(span), "key bigint, piece binary, weight bigint, hot boolean, data binary"), "piece-bytes")
    ordered = cut.where("NOT hot").select("key", "piece", "weight", "data").repartition("key").sortWithinPartitions("key", "piece")
    by_order = ordered.mapInArrow(_sorted_groups(span), f"key bigint, piece binary, runs {SPANS}")
    windows = cut.where("hot").select("key", "piece", "weight", "data").distinct().mapInArrow(_windows(span), "hash binary, key bigint, piece binary, a bigint, weight bigint")
    windows = stored(windows, "windows")
    twice = windows.groupBy("hash").agg(F.sum("weight").alias("n")).where("n > 1").select("hash")
    by_hash = windows.where("weight = 1").join(twice, "hash", "left_semi").groupBy("key", "piece").agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).cast(SPANS).alias("runs"))
    copies = each.where("weight > 1").select("key", "piece", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))).cast(SPANS).alias("runs"))
    results = stored(copies.unionByName(by_order).unionByName(by_hash), "repeated-windows")
    drop_stored(each, cut, windows)
    placed = shared.join(results, ["key", "piece"]).select("node", "start", F.explode("runs").alias("r")).select("node", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).alias("r"))
    spans = stored(placed.groupBy("node").agg(F.collect_set("r").cast(SPANS).alias("runs")), "repeated-spans")
    drop_stored(shared, results)
    return spans


def dedup_substrings(docs: DataFrame, *, span: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256 (string) and spans (array of a, b) for every row of ``docs``.

    A byte goes if a string of ``span`` bytes (at least two grams) around it starts at another place as well, in the same
    document (also overlapping) or in another; what repeats is judged on the texts as they are, whole, as UTF-8. A null text is
    empty; texts of fewer bytes lose nothing; null ids and repeated rows are documents like any other, so the copies of a
    text of ``span`` bytes lose everything. Other columns are left out, an empty table gives no rows.
    """
    if span < 2 * GRAM:
        raise ValueError(f"a span has {2 * GRAM} bytes at least")
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"))
    long = F.coalesce(F.octet_length("text") >= span, F.lit(False))
    runs = repeated_spans(texts.where(long), span)
    there = texts.where(long).join(runs, "node", "left").select("doc_id", "text", "runs")
    short = texts.where(~long).select("doc_id", "text", F.lit(None).cast(SPANS).alias("runs"))
    return there.unionByName(short).mapInArrow(_removed(span), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}")

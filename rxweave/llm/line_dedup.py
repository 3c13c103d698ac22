"""Line dedup: rolling hashes over line hashes, at every line; repeated multi-line chunks go after a comparison of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import drop_stored, small, stored

#: A line of more words than this is a chunk of its own.
LONG_WORDS = 50
#: Places of one hash that one task compares: the first place goes out once for each so many others.
DEAL = 1000


def is_long(line: bytes) -> bool:
    return len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS


def chunks_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first, end) of each chunk: two lines with a word and the blank lines between them, at every such line; and each long line.

    Where a chunk starts and ends depends on its own lines alone, so a run of two lines or more has the same chunks whatever is
    next to it, and every line of it is in one.
    """
    filled = [i for i, line in enumerate(lines) if line and not line.isspace()]
    return [(i, j + 1) for i, j in zip(filled, filled[1:], strict=False)] + [(i, i + 1) for i in filled if is_long(lines[i])]


def rolling(first: np.ndarray, last: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The hash of a chunk from the hashes of its first and last line and the number of its lines."""
    out = first * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F) + lines.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in small(batches):
        rows, at, first, last = [], [], [], []
        for row, t in enumerate(batch.column(2).to_pylist()):
            lines = t.split(b"\n")
            chunks = chunks_of(lines)
            if chunks:
                hashes = [digest(x) for x in lines]
                rows += [row] * len(chunks)
                at += chunks
                first += [hashes[a] for a, _ in chunks]
                last += [hashes[b - 1] for _, b in chunks]
        begin, end = np.array(at, np.int32).reshape(-1, 2).T
        hashes = rolling(np.array(first, np.uint64), np.array(last, np.uint64), end - begin).view(np.int64)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begin), pa.array(end)], names=["hash", "key", "th", "from", "to"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a text's repeated chunks."""
    kind = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("first", pa.bool_()), ("deals", pa.int32()), ("chunk", pa.binary())])
    for batch in small(batches):
        rows = []
        for k, t, th, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            lines = t.split(b"\n")
            rows += [(m["hash"], k, th, m["from"], m["to"], m["first"], m["deals"], b"\n".join(lines[m["from"] : m["to"]])) for m in marks]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove repeated runs of lines from whole texts: key, text, n_lines, n_removed, removed, and the ``keep`` columns.

    A chunk is two neighbouring lines with a word (and the blank lines between them), or a line of over fifty words; chunks
    start at every line. A chunk whose rolling hash is met more than once keeps its first place (smallest key, then text
    hash, then place); at every other place its bytes are compared with the first, and if they are equal its lines go. So
    every later place of a run of two lines or more goes as a whole, whatever is next to it. Single shorter lines that
    repeat stay, and so does the first place of every chunk: a place that overlaps the first one doesn't count.
    ``removed`` lists runs of removed lines as first-last.

    Texts meet their own marks, and then their own cuts, in sort-merge joins at any size: what a task holds doesn't depend on
    how many texts repeat something. Hashes are counted before the shuffle; the places of one hash are dealt out by
    DEAL, each deal with its own copy of the single first place, so no task gets all places of a common chunk.

    Null text stays null with no lines. A text whose lines all go becomes empty. Equal rows (key and text) are one
    document and are treated alike; a null key is later than any other. Empty tables give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("rest"))
    hashed = rows.withColumn("th", F.xxhash64("text"))
    chunks = stored(hashed.where("text is not null").select("key", "th", "text").mapInArrow(_chunk_rows, "hash long, key long, th long, from int, to int"), "line-chunks")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "th", "from", "to")
    counted = chunks.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low <> high")
    repeated = stored(counted.select("hash", "low", (1 + F.floor(F.col("n") / DEAL)).cast("int").alias("deals")), "line-repeated")
    marked = chunks.join(repeated, "hash").withColumn("first", place == F.col("low"))
    marks = stored(marked.groupBy("key", "th").agg(F.collect_set(F.struct("from", "to", "hash", "first", "deals")).alias("marks")), "line-marks")
    drop_stored(chunks, repeated)
    same = hashed["key"].eqNullSafe(F.col("mkey")) & (hashed["th"] == F.col("mth"))
    named = marks.withColumnsRenamed({"key": "mkey", "th": "mth"})
    found = hashed.select("key", "text", "th").join(named.hint("merge"), same).select("key", "text", "th", "marks")
    found = stored(found.mapInArrow(_places, "hash long, key long, th long, from int, to int, first boolean, deals int, chunk binary"), "line-places")
    drop_stored(marks)
    once = found.where("first").groupBy("hash").agg(F.first(F.struct(F.col("chunk").alias("c"), F.col("key").alias("k"), F.col("th").alias("t"), F.col("to").alias("e"), "deals")).alias("f"))
    firsts = once.select("hash", "f", F.explode(F.sequence(F.lit(0), F.col("f.deals") - 1)).alias("deal"))
    others = found.where("not first").withColumn("deal", F.pmod(F.xxhash64("key", "th", "from"), F.col("deals")).cast("int"))
    overlapping = F.col("key").eqNullSafe(F.col("f.k")) & (F.col("th") == F.col("f.t")) & (F.col("from") < F.col("f.e"))
    pairs = others.join(firsts, ["hash", "deal"]).where((F.col("chunk") == F.col("f.c")) & ~overlapping)
    cuts = stored(pairs.groupBy("key", "th").agg(F.collect_set(F.struct("from", "to")).alias("cuts")), "line-cuts").withColumnsRenamed({"key": "mkey", "th": "mth"})
    drop_stored(found)
    final = hashed.join(cuts.hint("merge"), same, "left").select("key", "text", "cuts", "rest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, counts, gone, spans = [], [], [], []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = [] if t is None else t.split(b"\n")
                out = np.zeros(len(lines), bool)
                for x in c or ():
                    out[x["from"] : x["to"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                texts.append(None if t is None else b"\n".join([x for x, o in zip(lines, out, strict=True) if not o]) if c else t)
                counts.append(len(lines))
                gone.append(int(out.sum()))
                spans.append(",".join(f"{a}-{b - 1}" for a, b in zip(edges[::2], edges[1::2], strict=True)))
            new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, batch.column(3)], names=["key", "text", "n_lines", "n_removed", "removed", "rest"])

    kind = "key long, text string, n_lines long, n_removed long, removed string, rest " + rows.schema["rest"].dataType.simpleString()
    done = final.mapInArrow(cut, kind)
    return done.select(F.col("key").alias(key), F.col("text").alias(text), "n_lines", "n_removed", "removed", *[F.col("rest")[c].alias(c) for c in keep])


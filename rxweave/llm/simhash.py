"""SimHash near-duplicates, with pigeonring filtering of candidates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import Hashes, components, drop_stored, small, stored

#: Four segments of 16 bits. At two differing bits the proportional budgets of a chain of one to four segments are
#: 0, 1, 1 and 2 bits.
SEGMENTS = ((0, 16), (16, 32), (32, 48), (48, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(low: int, high: int) -> int:
    return ((1 << (high - low)) - 1) << low


def fingerprint_of(words: list[bytes], size: int) -> int:
    """Majority vote of the 64 bits of the shingles' XXH64 (seed 42); no words: 0; a tie is 0."""
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - size + 1)
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(join(words[i : i + size]), seed=42) for i in range(low, min(n, low + (1 << 16)))), np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the signed 64-bit fingerprint of every whole text. A-Z are lower-cased; words lie between white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.array([fingerprint_of((t or b"").lower().split(), size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.astype(np.uint64).view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, fp long").withColumnRenamed("key", key)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within two bits; ``distinct`` has fp.

    Pigeonring: of two fingerprints within two bits, some segment i starts a chain whose cumulative differences stay
    within 0, 1, 1 and 2 bits. The chain is checked link by link, as groups of equal keys and never as pairs. A chain of
    three segments within one bit has two equal ones, so first come fingerprints that share two of four segments with
    another one; of those, the ones that share segment i and, but for one bit, the next two (as keys with one of those
    bits cleared). A fingerprint that passes neither has no partner. The rest get the full check: two are within two
    bits just if their balls of one bit meet, so each ball's members are linked to its least member, and the Hamming
    distance of each link is verified. The number of rows is a fixed multiple of the fingerprints, whatever the size
    of a group.
    """
    masks = [_mask(*s) for s in SEGMENTS]
    two = [F.struct(F.lit(n).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[j]))).alias("part")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    first = distinct.select("fp", F.explode(F.array(*two)).alias("k")).select("fp", "k.i", "k.part")
    shared = first.groupBy("i", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first.join(shared, ["i", "part"], "left_semi").select("fp").distinct(), "simhash-first")
    chains = []
    for i in range(4):
        then = masks[(i + 1) % 4] | masks[(i + 2) % 4]
        for bit in (b for b in range(64) if then >> b & 1):
            part = F.col("fp").bitwiseAND(F.lit(_signed((masks[i] | then) & ~(1 << bit))))
            chains.append(F.struct(F.lit(64 * i + bit).alias("i"), part.alias("part")))
    second = first.select("fp", F.explode(F.array(*chains)).alias("k")).select("fp", "k.i", "k.part")
    shared = second.groupBy("i", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    left = stored(second.join(shared, ["i", "part"], "left_semi").select("fp").distinct(), "simhash-second")
    ball = left.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("z"))
    centre = ball.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (
        ball.join(centre, "z").select("a", F.col("fp").alias("b")).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 3, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): documents whose fingerprints are linked at two or fewer differing bits.

    component_id is the smallest key that is reachable, the own one included. Equal fingerprints are one node, so a
    group of copies costs one node; links and components stay distributed. Null or blank texts have fingerprint zero,
    linked like any other; null keys keep their row and are never a component's id (null if it has no other);
    repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs, size, key=key, text=text).withColumnRenamed(key, "key"), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    roots = stored(components(links(distinct), "simhash-links"), "simhash-roots").withColumnRenamed("node", "fp")
    ids = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(ids.join(named, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(by_print, "fp").select(F.col("key").alias(key), "fp", "component_id")


#: Boxes of a segmented fingerprint, shingles sampled into each, and boxes that may differ. At a similarity of 0.8 a box
#: is equal with probability 0.8 ** 3, and at most 16 of 20 differ with probability 0.999.
BOXES, SAMPLE, BUDGET = 20, 3, 16


def shingle_hashes(text: bytes | None, size: int, known: Hashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted: the words' XXH64, each times an odd factor of its place, summed and mixed.
    Fewer words are one shingle; no words: none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out += hashes[i : i + n] * np.uint64(2 * xxhash.xxh32_intdigest(f"place{i}") * 0x9E3779B9 & 0xFFFFFFFFFFFFFFFF | 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


#: What the boxes' permutations flip and multiply by.
_FLIPS = np.array([[xxhash.xxh64_intdigest(f"flip{b}")] for b in range(BOXES)], np.uint64)
_FACTORS = np.array([[xxhash.xxh64_intdigest(f"box{b}") | 1] for b in range(BOXES)], np.uint64)


def boxes_of(hashes: np.ndarray, sample: int = SAMPLE) -> np.ndarray:
    """A SimHash for each box, voted by the shingles that are least under the box's permutation."""
    out = np.zeros(BOXES, np.int64)
    if len(hashes):
        k = min(sample, len(hashes))
        step = max(1, min(BOXES, (1 << 20) // len(hashes)))  # boxes at once, so a long text needs no more memory
        for low in range(0, BOXES, step):
            mixed = (hashes ^ _FLIPS[low : low + step]) * _FACTORS[low : low + step]
            mixed ^= mixed >> np.uint64(32)
            votes = hashes[np.argpartition(mixed, k - 1, axis=1)[:, :k]]
            bits = np.unpackbits(votes.astype("<u8").view(np.uint8).reshape(-1, k, 8), axis=2, bitorder="little").sum(axis=1)
            out[low : low + step] = np.packbits(bits * 2 > k, axis=1, bitorder="little").view("<i8").ravel()
    return out


def chain_holds(a: np.ndarray, b: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Pigeonring: whether some start has every chain of consecutive boxes within its proportional budget.

    Rows of a and b are segmented fingerprints; a whole ring within the budget always has such a start.
    """
    return ring_holds(a != b, budget)


def ring_holds(differ: np.ndarray, budget: int | np.ndarray) -> np.ndarray:
    """The same from the differences of the boxes, in numbers; the budget may be another one for each row (a column)."""
    m = differ.shape[1]
    sums = np.cumsum(np.concatenate([np.zeros((len(differ), 1), int), differ, differ], axis=1), axis=1)
    held = np.ones(differ.shape, bool)
    for length in range(1, m + 1):
        held &= sums[:, length : length + m] - sums[:, :m] <= length * budget / m
    return held.any(axis=1)


#: Words that a ring of turned bits is folded to.
FOLDED = 5
#: Cells of the table of shingle frequencies, cells of one of its blocks, the count up to which a cell is rare, and nodes in a block of a
#: large group.
CELLS_LOG, BLOCK_LOG, RARE, GROUP_BLOCK = 22, 12, 7, 512
#: Blocks (log2) that prefix shingles are counted in, bits (log2) of the table of those that can meet, and shingles that a task holds.
MEET_BLOCKS_LOG, MEET_LOG, MEET_AT_A_TIME = 10, (16, 28), 1 << 20


def toggles_of(hashes: np.ndarray, boxes: int = BOXES) -> list[int]:
    """A ring of words of 64 bits; each shingle turns one bit over. Two sets differ in at least as many shingles as bits."""
    at = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % (64 * boxes)
    odd = np.bincount(at, minlength=64 * boxes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def prefix_of(hashes: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles, so many that two sets at the similarity or above share one of them: in the order of the
    frequency level of their cells, then of the hash, which is the same order for every set."""
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    level = levels[(hashes >> np.uint64(64 - CELLS_LOG)).astype(np.int64)]
    return hashes[np.lexsort((hashes, level))[:n]]


def _levels(rows: DataFrame, size: int) -> np.ndarray:
    """A level (log2 of a count over all rows) for each cell of shingle hashes; it orders shingles, so that the common ones come last.

    The counts are those of all rows, however they are dealt over tasks. A task hands on the blocks that it has met, compressed
    byte by byte of the counts; blocks are summed where they meet, and the driver gets a byte for each of the table's cells.
    """
    blocks, cells = 1 << (CELLS_LOG - BLOCK_LOG), 1 << BLOCK_LOG

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(blocks * cells, np.uint32), Hashes()
        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                counts[(shingle_hashes(t, size, known) >> np.uint64(64 - CELLS_LOG)).astype(np.int64)] += 1
        for n, block in enumerate(counts.reshape(blocks, cells)):
            if block.any():
                packed = zlib.compress(block.astype("<u4").view(np.uint8).reshape(cells, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packed], pa.binary())], names=["block", "packed"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, cells).T.copy().view("<u4").ravel()
                sums[n] = sums.get(n, 0) + counts.astype(np.int64)
        levels = [np.where(x > RARE, np.log2(np.maximum(x, 1)), 0).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])

    packed = rows.select("text").mapInArrow(count, "block int, packed binary").repartition("block")
    levels = np.zeros((blocks, cells), np.uint8)
    for r in packed.mapInArrow(total, "block int, levels binary").collect():  # a row for each block
        levels[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def _can_meet(nodes: DataFrame) -> np.ndarray:
    """A table of bits by the first bits of a shingle's hash: set where a prefix shingle of two nodes or more falls.

    Shingles are counted by 42 bits of their hashes, of which a shuffle carries 32 in blocks; equal ones are always counted
    together, so a shingle whose bit isn't set is in one prefix only. The table follows the number of prefix shingles, up to
    2 ** 28 bits (32 MB at the driver); where it fills up, more shingles pass than need to.
    """
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    low, high = MEET_LOG
    log = min(high, max(low, int(total).bit_length()))
    shift = np.uint64(64 - MEET_BLOCKS_LOG)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            blocks, starts = np.unique(tokens >> shift, return_index=True)
            parts = np.split(((tokens >> np.uint64(32 - MEET_BLOCKS_LOG)) & np.uint64(0xFFFFFFFF)).astype("<u4"), starts[1:])
            return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "packed"])

        for batch in small(batches):
            held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
            if sum(map(len, held)) >= MEET_AT_A_TIME:
                yield out()
                held = []
        if sum(map(len, held)):
            yield out()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(n, []).append(np.frombuffer(x, "<u4"))
        for n, own in parts.items():
            values = np.sort(np.concatenate(own))
            bits = np.zeros(1 << (log - MEET_BLOCKS_LOG), np.uint8)
            bits[values[1:][values[1:] == values[:-1]] >> np.uint32(32 - log + MEET_BLOCKS_LOG)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    table = np.zeros((1 << MEET_BLOCKS_LOG, 1 << (log - MEET_BLOCKS_LOG - 3)), np.uint8)
    counted = nodes.select("prefix").mapInArrow(packed, "block int, packed binary").repartition("block")
    for r in counted.mapInArrow(twice, "block int, bits binary").collect():  # a row for each block
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def meets(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the bit of each shingle hash is set in a table of ``_can_meet``."""
    cell = tokens >> np.uint64(64 - (8 * len(table) - 1).bit_length())
    return (table[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _rest(nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that may be similar and are not yet in one component, by an exact path.

    Two sets at the similarity or above share a shingle of their prefixes; shingles that are in one prefix only leave their
    rows first, before anything is shuffled by shingle (see ``_can_meet``). Groups of nodes with a common prefix shingle
    are taken in all pairs, but for pairs of one component; a large group is dealt out in pairs of blocks. Pairs whose sizes,
    places in the prefix or folded bits rule the similarity out never leave the join. Then pigeonring on the rings of turned bits: the sets differ in
    at least as many shingles as bits, so at the similarity the budget is what their sizes allow, and no pair is lost.
    """
    # the ring folded to a few words: also turned by at most as many shingles as differ, and small enough for every member row
    bits = F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [F.col("toggles")[i] for i in range(n, BOXES, FOLDED)]) for n in range(FOLDED)])
    table = nodes.sparkSession.sparkContext.broadcast(_can_meet(nodes))

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prefix = batch.column(3)
            tokens, sizes = prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy().astype(np.int64)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = meets(tokens.view(np.uint64), table.value)
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept], pa.int64())) for x in (place, tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["node", "size", "bits", "places", "tokens"]).filter(pa.array(n > 0))

    met = nodes.select("node", "size", bits.alias("bits"), "prefix").mapInArrow(meeting, "node long, size long, bits array<long>, places array<long>, tokens array<long>")
    met = stored(met, "similar-meeting")
    each = F.explode(F.arrays_zip("places", "tokens")).alias("each")
    rooted = met.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "bits", each)
    rooted = rooted.select("node", "root", "size", "bits", F.col("each.places").alias("place"), F.col("each.tokens").alias("token"))
    shared = rooted.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    shared = shared.select("token", (1 + F.floor(F.col("n") / GROUP_BLOCK)).cast("int").alias("k"))
    member = rooted.join(shared, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    member = stored(member, "similar-members")
    dealt = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    x = dealt.where("o >= block").select("token", F.col("block").alias("c"), F.col("o").alias("d"), F.struct("node", "root", "size", "place", "bits").alias("x"))
    y = dealt.where("o <= block").select("token", F.col("o").alias("c"), F.col("block").alias("d"), F.struct("node", "root", "size", "place", "bits").alias("y"))
    both = F.col("x.size") + F.col("y.size")
    differing = reduce(lambda a, b: a + b, [F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(FOLDED)])
    near = x.join(y, ["token", "c", "d"]).where(
        (F.col("x.root") != F.col("y.root"))
        & ((F.col("c") != F.col("d")) | (F.col("x.node") < F.col("y.node")))
        & (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6)
        & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= both * (similarity / (1 + similarity)) - 1e-6)
        & (differing <= both * ((1 - similarity) / (1 + similarity)) + 1e-6)
    )
    pairs = stored(near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "similar-rest")
    drop_stored(met, member)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, BOXES) for i in (2, 3))
                differ = np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)
                budget = batch.column(4).to_numpy() * ((1 - similarity) / (1 + similarity)) + 1e-6
                ok = pa.array(ring_holds(differ, budget[:, None]) & (differ.sum(axis=1) <= budget))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("toggles").alias("x"), F.col("size").alias("m"))
    right = nodes.select(F.col("node").alias("b"), F.col("toggles").alias("y"), F.col("size").alias("n"))
    laid = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("both"))
    found = stored(laid.mapInArrow(held, "a long, b long"), "similar-held")
    drop_stored(pairs)
    return found


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, component_id, leader): documents linked at a Jaccard similarity of their shingle sets of ``similarity`` or more.

    At that similarity one 64-bit SimHash differs in about ten bits, so here a fingerprint is a ring of 20 boxes, each the
    SimHash of a small sample of the shingles, and a box differs or not. Candidates are found by pigeonring: the first box of
    a viable chain is equal, the cumulative differences of the boxes after it stay within the proportional budget, and the
    full count of differing boxes within the budget. The similarity of the rest is then counted exactly.

    Equal texts are one node (the 64-bit hash of the text, returned as ``node``); ``leader`` is the node of
    the document that component_id names, or, where all keys are null, the least node. First, in a group of nodes that share a box,
    or a box and the next, each is compared with three members (the least, the greatest and one by hash), which joins most
    of what is similar in few rows. That alone loses links, so all pairs that are still in different components then go
    through an exact path (see ``_rest``): the components are those of all pairs. Words and case as
    in ``near_duplicates``; texts without words are equal to each other. Null text is empty; null keys and repeated rows
    keep their rows; empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumn("node", F.xxhash64("text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in small(batches):
            sets = [shingle_hashes(t, size, known) for t in batch.column(1).to_pylist()]
            found = [[boxes_of(x) for x in sets], [toggles_of(x) for x in sets], [prefix_of(x, levels.value, similarity).view(np.int64) for x in sets]]
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(x, pa.list_(pa.int64())) for x in found], sizes], names=["key", "node", "boxes", "toggles", "prefix", "size"]
            )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in small(batches):
            found = pa.array([shingle_hashes(t, size, known).view(np.int64) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), found], names=["node", "set"])

    def viable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                a, b = (np.array(batch.column(i).to_pylist(), np.int64) for i in (2, 3))
                ok = pa.array(chain_holds(a, b) & ((a != b).sum(axis=1) <= BUDGET))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.array(x, np.int64), np.array(y, np.int64), assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    levels = docs.sparkSession.sparkContext.broadcast(_levels(rows, size))
    kind = "key long, node long, boxes array<long>, toggles array<long>, prefix array<long>, size long"
    prints = rows.mapInArrow(sampled, kind)
    made = F.first(F.struct("boxes", "toggles", "prefix", "size")).alias("made")
    nodes = stored(prints.groupBy("node").agg(F.min("key").alias("least"), made).select("node", "least", "made.*"), "similar-nodes")
    keys = stored(rows.select("key", "node"), "similar-keys")
    ring = F.arrays_zip("boxes", F.concat(F.slice("boxes", 2, BOXES - 1), F.slice("boxes", 1, 1)).alias("then"))
    starts = F.flatten(F.transform(ring, lambda x, i: F.array(F.xxhash64(i, x["boxes"]), F.xxhash64(i, x["boxes"], x["then"]))))
    box = nodes.select("node", F.explode(starts).alias("start"))
    some = F.min_by("node", F.xxhash64("node"))  # in one order for all boxes, so that alike nodes face few centres and not one for each box
    centre = box.groupBy("start").agg(F.array_distinct(F.array(F.min("node"), F.max("node"), some)).alias("centres"), F.count("*").alias("n")).where("n > 1").drop("n")
    faced = box.join(centre, "start").select(F.col("node").alias("b"), F.explode("centres").alias("a")).where("a <> b")
    pairs = stored(faced.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-pairs")
    left = nodes.select(F.col("node").alias("a"), F.col("boxes").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("boxes").alias("y"))
    near = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(viable, "a long, b long"), "similar-viable")
    drop_stored(pairs)

    def linked(near: DataFrame) -> DataFrame:
        """The pairs whose similarity, counted exactly, is high enough (a stored table)."""
        asked = near.select(F.col("a").alias("node")).union(near.select(F.col("b"))).distinct()
        asked = stored(asked.join(nodes.select("node", F.col("least").alias("lkey")), "node").withColumnRenamed("node", "lnode"), "similar-asked")
        chosen = rows.join(asked, (F.col("node") == F.col("lnode")) & F.col("key").eqNullSafe(F.col("lkey"))).select("text", "node")
        found = stored(chosen.mapInArrow(sets, "node long, set array<long>").dropDuplicates(["node"]), "similar-sets")
        left, right = found.select(F.col("node").alias("a"), F.col("set").alias("x")), found.select(F.col("node").alias("b"), F.col("set").alias("y"))
        links = stored(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "similar-alike")
        drop_stored(near, asked, found)
        return links

    links = linked(near)
    roots = stored(components(links, "similar-links"), "similar-roots")
    rest = _rest(nodes, roots, similarity)
    if not rest.isEmpty():
        roots = stored(components(links.unionByName(linked(rest)), "similar-links"), "similar-roots")
    drop_stored(links)
    ids = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lead = F.min(F.struct(F.col("least").isNull().alias("last"), F.col("least").alias("component_id"), F.col("node").alias("leader"))).alias("lead")
    named = ids.groupBy("root").agg(lead).select("root", "lead.component_id", "lead.leader")
    by_node = stored(ids.join(named, "root").select("node", "component_id", "leader"), "similar-components")
    drop_stored(nodes)
    return keys.join(by_node, "node").select(F.col("key").alias(key), "node", "component_id", "leader")

"""License scan: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import small, stored

#: A-Z become lower case, and bytes outside words become spaces: words are runs of [0-9a-z] and of bytes over 0x7F.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """``phrase``: the words must stand consecutively. Else ``threshold`` of the distinct words must be in one block."""

    label: str
    words: str
    threshold: float = 1.0
    phrase: bool = False

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(self.words.split())

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(set(self.tokens)) - 1e-9)


#: The base phrases and their labels.
BASE_TEMPLATES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)
#: The templates that the method adds.
EXTRA_TEMPLATES = (
    Template("apache-2.0", "licensed under apache license version 2 0", 0.8),
    Template("bsd", "redistribution source binary forms modification permitted provided conditions met", 0.8),
    Template("cc-by-nc", "licensed cc by nc", 0.8),
    Template("gpl-notice", "free software redistribute modify terms gnu general public license", 0.8),
    Template("mit", "released under mit license", 0.8),
    Template("mit-text", "permission hereby granted free charge person obtaining copy software", 0.8),
    Template("mpl", "source code form subject terms mozilla public license", 0.8),
)
#: A block is this many words, from any word on.
BLOCK = 64

_POSTINGS = "key long, n_words long, at array<int>, token array<int>"
_RESULT = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,words:int>>"


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [(t or b"").translate(FOLD).split() for t in batch.column(1).to_pylist()]
            hits = [[(i, vocabulary[w]) for i, w in enumerate(ws) if w in vocabulary] for ws in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([len(ws) for ws in rows], pa.int64()),
                    pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[t for _, t in h] for h in hits], pa.list_(pa.int32())),
                ],
                names=["key", "n_words", "at", "token"],
            )

    return run


class BlockJoin:
    """Joins every block (``block`` words from any word on) of one text with the templates; tokens are numbers, the globally
    rarest first, and a template's tokens have a place in that order.

    A block that meets a template's threshold has one of the template's first ``len - need + 1`` tokens (prefix filter): only
    places less than a block away from such a token are looked at. A run of them must have ``need`` different tokens
    (length filter), and what follows its rarest token in the template must be enough (positional filter). What remains is
    counted exactly, block by block, with two pointers: work grows with the places of template words.
    """

    def __init__(self, templates: Sequence[Template], rank: dict[str, int], block: int = BLOCK) -> None:
        self.templates, self.block = templates, block
        self.sets = [sorted({rank[w] for w in t.tokens}) for t in templates]
        self.exact = [[rank[w] for w in t.tokens] for t in templates]
        self.prefix: dict[int, list[int]] = {}
        self.member: dict[int, list[tuple[int, int]]] = {}
        for n, (t, s) in enumerate(zip(templates, self.sets, strict=True)):
            for p, token in enumerate(s):
                self.member.setdefault(token, []).append((n, p))
                if p <= len(s) - t.need:
                    self.prefix.setdefault(token, []).append(n)

    def runs(self, template: int, hits: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """The (word, place) hits less than a block away from a prefix token, in runs whose gaps are less than a block."""
        reach = len(self.sets[template]) - self.templates[template].need
        anchors = [i for i, p in hits if p <= reach]
        run: list[tuple[int, int]] = []
        a = 0
        for i, p in hits:
            while a < len(anchors) and anchors[a] <= i - self.block:
                a += 1
            if a == len(anchors) or anchors[a] >= i + self.block:
                continue
            if run and run[-1][0] <= i - self.block:
                yield run
                run = []
            run.append((i, p))
        if run:
            yield run

    def shared(self, template: int, run: list[tuple[int, int]]) -> int:
        """The most tokens of the template that one block of a run has; 0 if that is below ``need``."""
        size, need = len(self.sets[template]), self.templates[template].need
        places = {p for _, p in run}
        if len(places) < need or size - min(places) < need:
            return 0
        counts, have, best, low = [0] * size, 0, 0, 0
        for i, p in run:
            while run[low][0] <= i - self.block:
                counts[run[low][1]] -= 1
                have -= counts[run[low][1]] == 0
                low += 1
            have += counts[p] == 0
            counts[p] += 1
            best = max(best, have)
            if best == size:
                break
        return best if best >= need else 0

    def judge(self, at: list[int], token: list[int]) -> tuple[set[tuple[int, int]], dict[int, float]]:
        """(template, start) of every phrase place, and the best containment of each other template that is met."""
        places: set[tuple[int, int]] = set()
        met: dict[int, float] = {}
        hits: dict[int, list[tuple[int, int]]] = {n: [] for t in set(token) for n in self.prefix.get(t, ())}
        if not hits:
            return places, met
        for i, t in zip(at, token, strict=True):
            for n, p in self.member[t]:
                if n in hits:
                    hits[n].append((i, p))
        here = dict(zip(at, token, strict=True))
        for n, own in hits.items():
            if self.templates[n].phrase:
                words = self.exact[n]
                lead = self.sets[n].index(words[0])
                places.update((n, i) for i, p in own if p == lead and all(here.get(i + k) == w for k, w in enumerate(words)))
            elif best := max((self.shared(n, run) for run in self.runs(n, own)), default=0):
                met[n] = best / len(self.sets[n])
        return places, met


def scan_licenses(
    docs: DataFrame, base: Sequence[Template] = BASE_TEMPLATES, extra: Sequence[Template] = EXTRA_TEMPLATES, *, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Find license templates in whole texts; one row out for each row in.

    One pass over the texts writes each row's places of template words; their global counts (a row for each template
    word) order the tokens; the second pass, over those places alone, joins every block of ``block`` words, wherever it
    starts, with the templates. Templates come from the driver, so their tokens are bounded; no row is shuffled.
    No phrase may have more than ``block / 2`` words; longer texts are templates with a threshold.

    Columns: key, n_words, n_base (places of base phrases), first_word, last_word (smallest and largest start of one,
    else null), base_labels, labels (distinct, sorted, comma-joined), score (1 for a base phrase, else the best
    containment that met its threshold, else 0), spans (base places). Null text is empty; empty texts have no
    labels; rows with the same or a null key are judged on their own; other columns are ignored.
    """
    templates = [*base, *extra]
    if any(t.phrase and len(t.tokens) > block // 2 for t in templates):
        raise ValueError("a phrase is longer than half a block")
    words = sorted({w for t in templates for w in t.tokens})
    number = {w: i for i, w in enumerate(words)}
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    postings = stored(rows.mapInArrow(_postings({w.encode(): i for w, i in number.items()}), _POSTINGS), "license-words")
    counts = dict(map(tuple, postings.select(F.explode("token").alias("t")).groupBy("t").count().collect()))  # a row for each template word
    order = sorted(words, key=lambda w: (counts.get(number[w], 0), w))
    rank = {w: i for i, w in enumerate(order)}
    to_rank = [rank[w] for w in words]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = BlockJoin(templates, rank, block)
        for batch in small(batches):
            out = []
            for at, token in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                places, met = join.judge(at, [to_rank[t] for t in token])
                starts = [i for _, i in places]
                labels = {templates[n].label for n, _ in places}
                out.append(
                    {
                        "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {templates[n].label for n in met})),
                        "score": 1.0 if places else max(met.values(), default=0.0),
                        "spans": sorted(({"label": templates[n].label, "start": i, "words": len(templates[n].tokens)} for n, i in places), key=lambda s: (s["start"], s["label"])),
                    }
                )
            kind = pa.schema(
                [("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("words", pa.int32())])))]
            )
            rest = pa.Table.from_pylist(out, schema=kind).combine_chunks()
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "n_words", *kind.names])

    return postings.mapInArrow(judged, f"key long, n_words long, {_RESULT}").withColumnRenamed("key", key)

"""Language identification by multilingual mixture inference over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import small

#: Trigrams of bytes fall into this many cells.
CELLS = 1 << 16
#: Bytes of a lower-cased text: letters and bytes of longer characters stay, all else is a space.
FOLD = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: What one training task holds before it counts (bytes).
CHUNK = 1 << 22


def cells_of(text: str) -> np.ndarray:
    """The cell of every trigram of the whole text; runs of other characters count as one space."""
    folded = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split()) + b" "
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Mixture:
    """``logs``: log-probability of each cell for each language, shape (CELLS, languages)."""

    languages: tuple[str, ...]
    logs: np.ndarray
    #: Price of a further language, in nats for each natural log of the number of trigrams.
    penalty: float = 8.0
    #: Rounds at most, and the change of a proportion below which it is settled.
    rounds: int = 60
    settled: float = 1e-3

    def fit(self, counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood they reach."""
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        share = np.full(logs.shape[1], 1.0 / logs.shape[1])
        total = counts.sum()
        for _ in range(self.rounds if logs.shape[1] > 1 else 0):
            each = p * share
            before, share = share, (counts / each.sum(axis=1)) @ each / total
            if np.abs(share - before).max() < self.settled:
                break
        return share, float(counts @ (np.log(p @ share) + top[:, 0]))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """(main language, its proportion, all chosen languages with proportions); ``und`` without a letter."""
        if text is None or not any(map(str.isalpha, text)) or not self.languages:
            return "und", 0.0, []
        cells = cells_of(text)
        if not len(cells):  # letters that fold away
            return "und", 0.0, []
        counts = np.bincount(cells, minlength=CELLS)
        found = np.flatnonzero(counts)
        counts, logs = counts[found].astype(float), self.logs[found]
        share, _ = self.fit(counts, logs)
        order = np.argsort(-share, kind="stable")
        single = counts @ logs
        best, chosen, shares = float(single.max()), [int(single.argmax())], np.ones(1)
        price = self.penalty * np.log(counts.sum() + 1)
        for k in range(2, 1 + int((share > 0.01).sum())):
            some = [int(i) for i in order[:k]]
            part, likelihood = self.fit(counts, logs[:, some])
            if likelihood - (k - 1) * price > best:
                best, chosen, shares = likelihood - (k - 1) * price, some, part
        ranked = sorted(zip(shares.tolist(), [self.languages[i] for i in chosen], strict=True), key=lambda x: (-x[0], x[1]))
        return ranked[0][1], min(1.0, ranked[0][0]), [(lang, s) for s, lang in ranked]


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Mixture:
    """Trigram likelihoods from all rows with a text and a language.

    One pass counts trigrams by language; the counts of a task are summed by Spark, and what reaches the driver is
    a row for each language, of a fixed number of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def count() -> None:
            for name, parts in held.items():
                counts[name] = counts.get(name, 0) + np.bincount(np.concatenate(parts), minlength=CELLS)
            held.clear()

        for batch in small(batches):
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = cells_of(t)
                held.setdefault(name, []).append(found)
                size += len(found)
                if size > CHUNK:
                    count()
                    size = 0
        count()
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "cell", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most CELLS pairs a language
    table = {r["lang"]: np.array(r["cells"], np.int64).reshape(-1, 2) for r in packed.collect()}
    names = tuple(sorted(table))
    logs = np.full((CELLS, len(names)), smoothing)
    for j, name in enumerate(names):
        logs[table[name][:, 0], j] += table[name][:, 1]
    return Mixture(names, np.log(logs / logs.sum(axis=0)) if names else logs)


def identify(docs: DataFrame, training: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that ``training`` marks and infer every row: key, lang_pred, score, mixture.

    mixture lists the chosen languages and their proportions; lang_pred is the largest, score its proportion. Null text, or
    text without a letter, is ``und`` with score 0, and so is everything if there is nothing to learn from. Null keys
    and repeated rows are kept; nulls in ``training`` count as false; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(training), text=text, lang=lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [model.value.infer(t) for t in batch.column(1).to_pylist()]
            mixture = pa.array([[{"lang": a, "share": s} for a, s in m] for _, _, m in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), mixture], names=["key", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>").withColumnRenamed("key", key)

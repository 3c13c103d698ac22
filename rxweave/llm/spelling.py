"""Spelling variants: words of a corpus that differ by one letter, found by a rare-first bigram prefix filter.

The bigrams of a word are put in one global order, the rarest first (a bigram's frequency is the number of places that it has
in the vocabulary). One changed letter destroys at most two bigrams, so two near words share one of each other's three rarest,
at places that differ by at most one. Bigrams as rare as the third count as well where they are the same bigram, since
places of one bigram have no order that a change would keep.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import drop_stored, stored

#: What a run of letters is, and which are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One bigram destroyed for each letter of it, and one more.
PREFIX = 3
#: Fewest letters of a word: each of its halves then has three.
SHORTEST = 6
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def typed(run: str, doc_id: object, every: int) -> str:
    """The run as it counts: in one of ``every`` places, by its hash, a letter is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(least: int, every: int):
    pattern = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                for run, n in Counter(map(re.Match.group, pattern.finditer(text.as_py() or ""))).items():
                    if len(run) >= least and len(word := typed(run.translate(_LOWER), doc_id, every)) >= least:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield out()
        yield out()

    return run


def words_of(docs: DataFrame, *, least: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """(word, n): distinct words of at least ``least`` letters that occur at least ``often`` times. Tasks count before the shuffle."""
    counted = docs.select("doc_id", "text").mapInArrow(_counts(least, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _bigrams(word: str):
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(F.substring(F.col(word), i, F.lit(2)).alias("g"), i.alias("at")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all ordered pairs of near words of ``words`` (column ``word``, distinct, of six letters or more).

    Of a pair, the shorter word (or the smaller of one length) looks for the other: on a rare bigram, its length, one of its
    halves (a change in one half leaves the other alone), and the bigram's place, which is the same or, with a longer
    partner, one later. The join's condition verifies, so only near pairs come out of it.
    """
    grams = words.select(F.explode(_bigrams("word")).alias("x")).groupBy("x.g").agg(F.count("*").alias("f"))
    placed = words.select("word", F.explode(_bigrams("word")).alias("x")).select("word", F.col("x.g").alias("g"), F.col("x.at").alias("at"))
    # letters are of 26 + 64 kinds, so there are at most 8,100 bigrams
    ranked = placed.join(F.broadcast(grams), "g").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("f", "g", "at"))).alias("gs"))
    third = F.col("gs")[PREFIX - 1]
    rare = ranked.select("word", F.explode(F.filter("gs", lambda x: (x["f"] < third["f"]) | ((x["f"] == third["f"]) & (x["g"] <= third["g"])))).alias("x"))
    rare = rare.select("word", F.col("x.g").alias("g"), F.col("x.at").alias("at"))

    def halves(size) -> list:
        """Keys of a word that meets a partner whose shorter word has ``size`` letters."""
        return [F.concat(F.lit(sign), side("word", F.floor(size / 2).cast("int"))) for sign, side in (("<", F.left), (">", F.right))]

    size = F.length("word")
    short = rare.select(F.col("word").alias("a"), "g", "at", size.alias("size"), F.explode(F.array(*halves(size))).alias("half"))
    meets = [F.struct((F.col("at") - shift).alias("at"), (size - longer).alias("size"), half.alias("half")) for longer, shift in ((0, 0), (1, 0), (1, 1)) for half in halves(size - longer)]
    long = rare.select(F.col("word").alias("b"), "g", F.explode(F.array(*meets)).alias("m")).select("b", "g", "m.*")
    close = ((F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    once = short.join(long, ["g", "at", "size", "half"]).where(close).select("a", "b").distinct()
    return once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def spelling_groups(docs: DataFrame, *, least: int = 6, often: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) for every word of ``docs`` (columns doc_id, text).

    Words are the runs of RUN with A-Z lower-cased; where ``every`` divides the crc32 of ``doc_id:run`` (a null id is written as
    nothing) the run lacks the letter at that hash modulo its length. Those of ``least`` letters that occur ``often`` times
    in all count. A word's form is its near word with the largest n (ties: the smaller in code-point order), if that is
    ``times`` the word's n or more; its root is the last word that forms lead to. Null and empty texts have no words, texts
    count whole however long, repeated rows count as often as they are there, other columns are left out, and an empty
    table gives no rows.
    """
    if least < SHORTEST:
        raise ValueError(f"words need {SHORTEST} letters at least")
    words = stored(words_of(docs, least=least, often=often, every=every), "words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("b"))).alias("m"))
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    far = -F.col("m.less") >= times * F.col("n")
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("m.b")).alias("form"), F.when(far, -F.col("m.less")).alias("form_n")), "forms")
    drop_stored(words)
    # n grows ``times``-fold at each step, so chains are short; each pass doubles what is followed
    roots = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, roots = roots, stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_stored(old)
        if roots.where("moved").isEmpty():
            break
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

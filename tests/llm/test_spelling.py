import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rxweave.llm.queries import ORACLES, QUERIES
from rxweave.llm.spelling import near_pairs, spelling_groups


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, times=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    forms, rows = {}, []
    for w in n:
        met = [v for v in n if near(w, v)]
        best = min(met, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= times * n[w] else None
        forms[w] = (form, len(met))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        rows.append((w, form, root, n[w], n_near, n[form] if form else None))
    return sorted(rows)


def rows_of(found):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(compare, sf):
    compare(QUERIES, ORACLES, "op11_spelling", sf)


@pytest.mark.parametrize("seed", range(4))
def test_every_near_pair_is_met(spark, seed):
    """Words over few letters: bigrams repeat within a word and tie in frequency."""
    rnd = random.Random(seed)
    letters = ["ab", "abc", "aébÀ", "abcdefgh"][seed]
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(400)}
    for w in list(words)[:60]:
        at = rnd.randrange(len(w))
        words |= {w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa"}
    found = near_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_chains_ties_and_odd_rows(spark):
    counts = {"wordings": 5, "wordingz": 5, "wordinga": 25, "wordinge": 25, "wordinges": 125, "wordingeso": 700, "Étalage": 6, "étalage": 30, "lonely": 4, "×××÷÷÷": 5}
    text = " ".join(f"{w}." for w, c in counts.items() for _ in range(c))
    docs = [(1, text), (2, None), (3, ""), (None, "Wordings " * 7), (4, "WORDINGS etc"), (4, "WORDINGS etc"), (5, "a1b2c3 " + "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    want = brute(docs)
    assert rows_of(spelling_groups(df)) == want
    chain = {r[0]: r[2] for r in want}
    assert chain["wordinge"] == chain["wordings"] == "wordingeso" and chain["wordingz"] == "wordinga"
    assert spelling_groups(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(df, least=5)

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rxweave.llm import substrings
from rxweave.llm.queries import ORACLES, QUERIES
from rxweave.llm.substrings import dedup_substrings, merged, repeated_windows


def brute(docs, span):
    datas = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[p : p + span] for _, d in datas for p in range(len(d) - span + 1))
    rows = []
    for i, d in datas:
        gone = bytearray(len(d))
        for p in range(len(d) - span + 1):
            if seen[d[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        rows.append((i, len(d), sum(gone), sum(1 for p in range(len(d)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(found):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def corpus(rnd):
    passage, other = words(rnd, 60), words(rnd, 45)
    docs = [(i, words(rnd, rnd.randint(5, 120))) for i in range(40)]
    docs += [(100 + i, words(rnd, 20) + passage + words(rnd, 20)) for i in range(8)]
    docs += [(200 + i, words(rnd, 10) + passage[rnd.randint(0, 99) : -rnd.randint(1, 99)] + other + words(rnd, 3)) for i in range(8)]
    docs += [(300, docs[45][1]), (301, docs[45][1]), (300, docs[45][1]), (None, docs[46][1]), (None, docs[46][1] + "!"), (302, docs[47][1][:-1])]
    docs += [(400, "=" * 700), (401, "ab" * 300), (402, "x" * 199), (403, "y" * 200), (404, "z" * 201), (405, "é" * 150), (406, None), (407, ""), (408, passage + passage), (409, "\u0000" * 300 + "￿" * 90)]
    return docs


def test_sql(compare):
    compare(QUERIES, ORACLES, "op13_suffix_dedup")


@pytest.mark.parametrize(("seed", "group"), [(1, substrings.GROUP), (2, substrings.GROUP), (3, 1), (4, 4)])
def test_brute_force(spark, monkeypatch, seed, group):
    """Also with so small a group that windows of common keys are told apart one by one."""
    monkeypatch.setattr(substrings, "GROUP", group)
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("key", F.lit(1)).withColumn("runs", F.lit(1)).repartition(5)
    found = dedup_substrings(df, span=200)
    assert rows_of(found) == brute(docs, 200)
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t in docs}
    for r in found.where("doc_id < 100").collect():
        spans = [(s.a, s.b) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_removed and all(b <= len(texts[r.doc_id, r.n_bytes]) for _, b in spans)


def test_short_pieces_and_segments(spark, monkeypatch):
    rnd = random.Random(7)
    docs = corpus(rnd)
    want = brute(docs, 200)
    monkeypatch.setattr(substrings, "AT_A_TIME", 97)
    monkeypatch.setattr(substrings, "PIECE", 13)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by_hand = list(substrings.pieces_of(docs[44][1].encode(), 200))
    assert [s for s, *_ in by_hand] == [sum(n for _, n, *_ in by_hand[:i]) for i in range(len(by_hand))]
    assert sum(n for _, n, *_ in by_hand) == len(docs[44][1].encode()) - 199
    assert rows_of(dedup_substrings(df, span=200)) == want


def test_order_of_two_stages():
    rnd = random.Random(5)
    for _ in range(1500):
        span, letters = rnd.choice([2, 3, 5, 8]), rnd.choice(["a", "ab", "abc", "abcdef", "\x00ÿ"])
        pieces = ["".join(rnd.choice(letters) for _ in range(rnd.randint(span, span + 12))).encode() for _ in range(rnd.randint(1, 6))]
        seen = Counter(p[i : i + span] for p in pieces for i in range(len(p) - span + 1))
        text, begins, counts, order = substrings.suffix_order(pieces, span)
        starts = [text[i : i + span] for i in order.tolist()]
        assert starts == sorted(starts) and len(set(order.tolist())) == len(order) == counts.sum()
        for p, runs in zip(pieces, repeated_windows(pieces, span), strict=True):
            assert [any(a <= i < b for a, b in runs) for i in range(len(p) - span + 1)] == [seen[p[i : i + span]] > 1 for i in range(len(p) - span + 1)]


def test_spans_and_empty(spark):
    assert merged([{"a": 5, "b": 7}, {"a": 0, "b": 1}, {"a": 16, "b": 17}], 10) == [(0, 26)]
    assert merged([{"a": 0, "b": 1}, {"a": 11, "b": 12}], 10) == [(0, 10), (11, 21)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(empty, span=100)

import random
import re

import numpy as np
from pyspark.sql import functions as F

from rxweave.llm.decontaminate import masks_for, masks_of, need_of, overlaps, seed_hashes


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items, window=13, share=0.8):
    """The best overlap of every pair, from every diagonal and every window, by comparison of the words alone."""
    out = {}
    for k, t in docs.items():
        d = tokens(t)
        for n, it in items.items():
            w = tokens(it)
            size = min(window, len(w))
            best = None
            for shift in range(-len(w), len(d)):
                same = [0 <= i + shift < len(d) and d[i + shift] == w[i] for i in range(len(w))]
                if 5 * sum(same) < 4 * size:
                    continue
                good = [5 * sum(same[i : i + size]) >= 4 * size for i in range(len(w) - size + 1)] if size else []
                for first in (i for i, g in enumerate(good) if g and (i == 0 or not good[i - 1])):
                    last = first
                    while last + 1 < len(good) and good[last + 1]:
                        last += 1
                    equal = [i for i in range(first, last + size) if same[i]]
                    found = (len(equal), -(shift + equal[0]), equal[-1] + 1 - equal[0], shift + equal[-1])
                    best = max(best or found, found)
            if best:
                out[k, n] = (best[2], best[0], -best[1], best[3])
    return out


def test_overlaps_match_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"u{rng.randrange(3000)}"
    items = {n: " ".join(word() for _ in range(rng.choice([6, 9, 12, 20, 45]))) for n in range(1, 9)}
    docs = {}
    for k in range(1, 41):
        words = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            passage = items[rng.randint(1, 8)].upper().split()
            for i in range(len(passage)):
                if rng.random() < rng.choice([0, 0.08, 0.3]):
                    passage[i] = word()
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs[k] = rng.choice([" ", ", ", "\n"]).join(words)
    left = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("hash", F.lit(1))
    right = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, r.item_id): (r.n_words, r.n_equal, r.first_word, r.last_word) for r in overlaps(left, right).collect()}
    want = brute(docs, items)
    assert want and found.keys() == want.keys()
    assert all(found[p][1] == want[p][1] for p in want)


def test_planted_passages_with_substitutions_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    words = [f"q{i}" for i in range(20000)]
    items = {n: rng.sample(words, 40) for n in range(50)}
    docs = {}
    for k in range(50):
        passage = list(items[k])
        for i in range(rng.randrange(8), 40, 8):
            passage[i] = "replaced"
        docs[k] = rng.sample(words, 100) + passage + rng.sample(words, 100)
    docs |= {k: rng.sample(words, 300) for k in range(50, 100)}
    left = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    right = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in overlaps(left, right).collect()) == [(k, k) for k in range(50)]


def test_every_pattern_of_replaced_words_is_ignored_by_a_mask():
    from itertools import combinations

    for n in range(1, 14):
        wrong = n - need_of(n)
        for places in combinations(range(n), wrong):
            assert any(all(m[i] == "0" for i in places) for m in masks_for(n)), (n, places)
    assert all("1" in m for n in range(1, 20) for w in range(n) for m in masks_of(n, w))


def test_recall_over_items_of_every_length_and_replaced_words(spark):
    """Items of 1 to 45 words, verbatim and with words replaced up to the share and beyond, some cut short by the text's end."""
    rng = random.Random(21)
    word = lambda: f"r{rng.randrange(10**6)}"
    items, docs = {}, {}
    for n in range(1, 46):
        items[n] = [word() for _ in range(n)]
        for v in range(6):
            passage = list(items[n])
            for i in rng.sample(range(n), min(n, [0, 1, 2, n // 6, n // 5, n // 4][v])):
                passage[i] = word()
            cut = passage[rng.randint(0, n // 4) :] if v == 2 else passage
            docs[10 * n + v] = ([] if v == 2 else [word() for _ in range(rng.randint(0, 60))]) + cut + [word() for _ in range(rng.randint(0, 60))]
    text = lambda rows: {k: " ".join(w) for k, w in rows.items()}
    left, right = spark.createDataFrame(list(text(docs).items()), "doc_id long, text string"), spark.createDataFrame(list(text(items).items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_words, r.n_equal, r.first_word, r.last_word) for r in overlaps(left, right).collect()}
    want = brute(text(docs), text(items))
    assert len(want) > 150 and found == want


def test_masks_ignore_their_zeros():
    words = np.arange(1, 41, dtype=np.uint64)
    for mask in masks_of(13, 2) + masks_of(7, 1):
        changed = words.copy()
        for i, c in enumerate(mask):
            if c == "0":
                changed[i] = 999
        assert seed_hashes(words, mask)[0] == seed_hashes(changed, mask)[0]
        changed[mask.index("1")] = 998
        assert seed_hashes(words, mask)[0] != seed_hashes(changed, mask)[0]


def test_a_very_long_text_and_many_in_one_batch(spark):
    rng = random.Random(3)
    items = {1: [f"a{i}" for i in range(30)], 2: [f"b{i}" for i in range(14)]}
    noise = lambda n: [f"n{rng.randrange(10**5)}" for _ in range(n)]
    long = noise(131_060) + items[1] + noise(131_100) + items[2] + noise(10)
    docs = [(1, " ".join(long)), *[(k, " ".join(noise(50) + items[1 + k % 2])) for k in range(2, 60)]]
    right = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.first_word, r.n_equal) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), right).collect())
    assert found == sorted([(1, 1, 131_060, 30), (1, 2, 131_060 + 30 + 131_100, 14), *[(k, 1 + k % 2, 50, 14 if k % 2 else 30) for k in range(2, 60)]])


def test_odd_rows(spark):
    passage = " ".join(f"a{i}" for i in range(20))
    left = spark.createDataFrame([(None, passage), (None, passage + " more"), (1, None), (2, ""), (3, passage), (3, passage), (3, "short two"), (4, passage + " z" * 100000), (5, "Short, one!")], "doc_id long, text string").withColumn("region", F.lit("x")).withColumn("hits", F.lit(1))
    right = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, None), (3, "short one"), (4, "")], "item_id long, text string").withColumn("iid", F.lit("x"))
    found = sorted((r.doc_id or 0, r.item_id or 0, r.n_words) for r in overlaps(left, right).collect())
    assert found == sorted([*[(k, n, 20) for k in (0, 0, 3, 4) for n in (0, 1)], (5, 3, 2)])
    assert overlaps(left.limit(0), right).count() == 0 and overlaps(left, right.limit(0)).count() == 0


def test_the_whole_table_matches_sql(compare):
    from rxweave.llm.queries import ORACLES, QUERIES

    compare(QUERIES, ORACLES, "op9_decontamination")

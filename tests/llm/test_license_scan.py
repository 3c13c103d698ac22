import random
import re

import pytest

from rxweave.llm.license_scan import BASE_TEMPLATES, EXTRA_TEMPLATES, Template, scan_licenses
from rxweave.llm.queries import ORACLES, QUERIES


def brute(text, block=64):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = [(t.label, i) for t in BASE_TEMPLATES for i in range(len(words)) if tuple(words[i : i + len(t.tokens)]) == t.tokens]
    met = {}
    for low in range(max(len(words), 1)):
        have = set(words[low : low + block])
        for t in EXTRA_TEMPLATES:
            share = len(have & set(t.tokens)) / len(set(t.tokens))
            if share >= t.threshold - 1e-9:
                met[t.label] = max(met.get(t.label, 0), share)
    base = {label for label, _ in places}
    starts = [i for _, i in places]
    score = 1.0 if places else max(met.values(), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(met))), round(score, 9)


def made(rng):
    vocabulary = sorted({w for t in BASE_TEMPLATES + EXTRA_TEMPLATES for w in t.tokens}) + ["alpha", "Ünder", "x1"]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 200))) for _ in range(60)]
    for t in EXTRA_TEMPLATES + BASE_TEMPLATES:
        words = list(t.tokens)
        out += [" ".join(words), " filler ".join(words), " ".join(rng.sample(words, len(words) - 1)), "pad " * rng.randint(20, 90) + "-".join(words).upper()]
    return out + [None, "", "...", "cc by" * 3, "cc by " * 5000, "All\x00rights\nRESERVED"]


def test_scan_matches_brute_force(spark):
    rows = list(enumerate(made(random.Random(2))))
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, token string, score double")
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in scan_licenses(df).collect()}
    assert found == {i: brute(t) for i, t in rows}


def test_a_text_is_found_at_any_offset(spark):
    """Seven words, nine fillers between each and the next but the last: 61 words, wherever they start."""
    words = "licensed under apache license version 2 0".split()
    spread = (" " + "filler " * 9).join(words)
    wide = (" " + "filler " * 15).join(words)  # at most four words in a block
    df = spark.createDataFrame([(n, "pad " * n + spread) for n in range(70)] + [(100 + n, "pad " * n + wide) for n in range(70)], "doc_id long, text string")
    assert {(r.doc_id < 100, r.labels, r.score) for r in scan_licenses(df).collect()} == {(True, "apache-2.0", 1.0), (False, "", 0.0)}


def test_null_and_repeated_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "none"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in scan_licenses(df).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert scan_licenses(df.limit(0)).count() == 0


def test_a_phrase_longer_than_half_a_block_is_refused(spark):
    with pytest.raises(ValueError):
        scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (Template("long", "w " * 40, phrase=True),))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(compare, sf):
    compare(QUERIES, ORACLES, "op1_license_scan", sf)

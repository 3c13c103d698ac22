import random

from pyspark.sql import functions as F

from rxweave.llm.line_dedup import DEAL, dedup_lines


def line(rng, n=8):
    return " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))


def brute_removed(texts):
    """Lines by the rule, with a dictionary of the first place of every two neighbouring lines and every long line."""
    first, gone = {}, {}
    for k in sorted(texts):
        own = texts[k].split("\n")
        filled = [i for i, x in enumerate(own) if x.strip()]
        runs = [(i, i + 1) for i in filled if len(own[i].split()) > 50] + [(filled[n], filled[n + 1] + 1) for n in range(len(filled) - 1)]
        gone[k] = set()
        for a, b in sorted(runs):
            other, end = first.setdefault(tuple(own[a:b]), (k, b))
            if (other, end) != (k, b) and (other != k or a >= end):
                gone[k] |= set(range(a, b))
    return {k: sorted(gone[k]) for k in texts}


def expanded(removed):
    return [i for part in removed.split(",") if part for a, b in [part.split("-")] for i in range(int(a), int(b) + 1)]


def test_removed_lines_match_brute_force(spark):
    rng = random.Random(9)
    passages = ["\n".join(line(rng) for _ in range(rng.randint(2, 9))) for _ in range(6)] + [line(rng, 70)]
    texts = {}
    for k in range(1, 80):
        parts = [line(rng) for _ in range(rng.randint(1, 12))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), p)
        texts[k] = "\n".join(parts)
    texts[80], texts[81], texts[82], texts[83], texts[84] = texts[5], "", "\n\n\n", "}\n\n}\n\n}\n\n}\nx\t" + line(rng, 60), "y\n}\n\n}\n \n"
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, n_lines int, hash string")
    found = {r.doc_id: r for r in dedup_lines(df).collect()}
    want = brute_removed(texts)
    assert {k: expanded(r.removed) for k, r in found.items()} == want
    for k, r in found.items():
        assert r.text == "\n".join(s for i, s in enumerate(texts[k].split("\n")) if i not in set(want[k]))
        assert r.n_removed == len(want[k]) and r.n_lines == len(texts[k].split("\n"))


def test_repeated_passages_of_over_fifty_words_keep_their_first_place_alone(spark):
    rng = random.Random(10)
    long, several = line(rng, 60), "\n".join(line(rng, 15) for _ in range(8))
    texts = {k: "\n".join([line(rng), line(rng), (long, several)[k % 2], line(rng)]) for k in range(1, 41)}
    texts |= {k: "\n".join(line(rng) for _ in range(5)) for k in range(41, 61)}
    found = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(long in r.text for r in found.values()) == 1 and sum(several in r.text for r in found.values()) == 1
    assert all(found[k].text == texts[k] for k in range(41, 61))


def test_short_repeated_lines_and_clean_documents_stay(spark):
    rng = random.Random(11)
    texts = {k: f"{line(rng)}\nshare this page with friends\n{line(rng)}" for k in range(1, 30)}
    found = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(found[k].text == t and found[k].n_removed == 0 for k, t in texts.items())


def test_odd_rows(spark):
    text = "first line of many words\nsecond line of many words\nthird line"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (7, text), (8, None)], "doc_id long, text string").withColumn("key", F.lit("x"))
    rows = sorted(((r.doc_id or 0, r.text, r.n_lines) for r in dedup_lines(df, keep=("key",)).collect()), key=str)
    assert rows == sorted([(0, "", 3), (3, text, 3), (3, text, 3), (7, "", 3), (8, None, 0)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_every_later_place_of_a_run_goes_whatever_its_length_and_neighbours(spark):
    rng = random.Random(13)
    texts, runs = {}, []
    for n in range(200):
        run = [line(rng, rng.choice([1, 2, 8])) for _ in range(rng.choice([2, 2, 3, 4, 5, 12]))] + ["a", "b"] * (n % 3 == 0)
        runs.append(run)
        for k in (2 * n, 2 * n + 1):
            texts[k] = "\n".join([line(rng), line(rng), *run, line(rng)])
    want, seen = {}, set()
    for k in sorted(texts):  # every run of two lines or more, of any length, that an earlier text has
        own, gone = texts[k].split("\n"), set()
        parts = {(i, j): "\n".join(own[i:j]) for i in range(len(own)) for j in range(i + 2, len(own) + 1)}
        for (i, j), part in parts.items():
            if part in seen:
                gone |= set(range(i, j))
        seen |= set(parts.values())
        want[k] = sorted(gone)
    found = {r.doc_id: expanded(r.removed) for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    print("kept of later places", sum(set(found[k]) != set(want[k]) for k in want), "of", sum(bool(v) for v in want.values()))
    assert found == want


def test_a_chunk_with_very_many_places_is_dealt_out_and_keeps_one(spark):
    rng = random.Random(14)
    texts = {k: f"{line(rng)}\nsame one\nsame two\n{line(rng)}" for k in range(1, 2 * DEAL + 500)}
    found = {r.doc_id: expanded(r.removed) for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {k: [] if k == 1 else [1, 2] for k in texts}


def test_the_whole_table_matches_sql(compare):
    from rxweave.llm.queries import ORACLES, QUERIES

    compare(QUERIES, ORACLES, "op7_line_dedup")

import random

import pytest
from pyspark.sql import functions as F

from rxweave.operators import profile_tables as T
from rxweave.operators.profiles import Profile, ProfileError, Quirk, define_profile

PROFILES, PARENTS = "name string, description string", "name string, parent string, ord int"
QUIRKS = "name string, ord int, id string, standard string, effect string, summary string, fixture string, source_category string, expected_warnings array<string>"
CODES = ["UNKNOWN_REJECT_CODE", "STATUS_CONFLICT", "VERSION_ABSENT"]


def tables(spark, made, parents, quirks):
    return spark.createDataFrame(made, PROFILES), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(quirks, QUIRKS)


@pytest.mark.parametrize("seed", range(3))
def test_tables_are_merged_as_objects_are(spark, seed):
    """Random graphs, diamonds included: everything is what ``define_profile`` gives one by one."""
    rnd = random.Random(seed)
    made, parents, quirks, objects = [], [], [], {}
    for i in range(25):
        name, description = f"p{i}", rnd.choice([None, f"text {i}"])
        above = rnd.sample(range(i), min(i, rnd.choice([0, 1, 1, 2, 3]))) if i else []
        own = [Quirk(q, rnd.choice(["script", "telecom"]), rnd.choice(["adds", "relaxes", "requires"]), f"by {name}", "a/b", "c", tuple(rnd.sample(CODES, rnd.randint(0, 2)))) for q in rnd.sample(["a", "b", "c", "d-e"], rnd.randint(0, 3))]
        made.append((name, description))
        parents += [(name, f"p{j}", n) for n, j in enumerate(above)]
        quirks += [(name, n, q.id, q.standard, q.effect, q.summary, q.fixture, q.source_category, list(q.expected_warnings)) for n, q in enumerate(own)]
        objects[name] = define_profile(name=name, quirks=own, extends=[objects[f"p{j}"] for j in above], **({} if description is None else {"description": description}))
    profiles, links, quirk_rows = tables(spark, made, parents, quirks)
    layers = T.layers_of(profiles, links)
    merged = T.merge_quirks(layers, quirk_rows)
    found = {}
    for r in merged.orderBy("name", "ord").collect():
        found.setdefault(r.name, []).append(Quirk(r.id, r.standard, r.effect, r.summary, r.fixture, r.source_category, tuple(r.expected_warnings)))
    told = T.describe_profiles(profiles, layers, merged).collect()
    assert len(told) == len(objects) and T.quirk_problems(quirk_rows).isEmpty()
    for r in told:
        want: Profile = objects[r.name]
        assert tuple(found.get(r.name, ())) == want.quirks and tuple(r.lineage) == want.lineage and r.description == want.description
        assert r.standards == want.standards and r.expected_warnings == want.expected_warnings
        assert [r.n_adds, r.n_relaxes, r.n_requires] == [len(want.describe()[e]) for e in ("adds", "relaxes", "requires")]


def test_cycles_and_parents_that_are_not_there(spark):
    made = [("a", None), ("b", None), ("c", None)]
    profiles, links, _ = tables(spark, made, [("a", "b", 0), ("b", "c", 0), ("c", "b", 0)], [])
    with pytest.raises(ProfileError, match="among its own parents") as caught:
        T.layers_of(profiles, links)
    assert caught.value.profile == "b"
    with pytest.raises(ProfileError, match="isn't there"):
        T.layers_of(profiles, tables(spark, made, [("a", "z", 0)], [])[1])


def test_rows_that_no_profile_may_have(spark):
    good = ("p", 0, "x", "script", "adds", "s", "a/b", "c", ["STATUS_CONFLICT"])
    bad = {
        "an id in kebab case": good[:2] + ("X y",) + good[3:], "a standard": good[:2] + ("b", "none") + good[4:], "an effect": good[:2] + ("c", "script", None) + good[5:], "a summary": good[:2] + ("d", "script", "adds", " ") + good[6:],
        "a relative fixture path": good[:2] + ("e", "script", "adds", "s", "/a") + good[7:], "a source category": good[:2] + ("f", "script", "adds", "s", "a/b", None) + good[8:], "known warning codes": good[:2] + ("g", "script", "adds", "s", "a/b", "c", ["NO"]),
    }
    rows = spark.createDataFrame([good, ("q", *good[1:]), *bad.values(), ("r", *good[1:]), ("r", *good[1:])], QUIRKS)
    found = [(r.name, r.id, r.problem) for r in T.quirk_problems(rows).collect()]
    assert sorted(p for n, _, p in found if n == "p") == sorted(bad) and [p for n, _, p in found if n != "p"] == ["an id of its own"] * 2


def test_warnings_by_a_column(spark):
    described = spark.createDataFrame([("p", ["STATUS_CONFLICT"]), ("q", [])], "name string, expected_warnings array<string>")
    w = F.array(*[F.struct(F.lit(c).alias("code")) for c in CODES]).alias("warnings")
    rows = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "nobody")], "i int, partner string").select("*", w)
    found = {r.i: ([x.code for x in r.expected], [x.code for x in r.unexpected]) for r in T.partition_warnings_by(rows, described, "partner").collect()}
    assert found[1] == (["STATUS_CONFLICT"], [CODES[0], CODES[2]]) and found[2] == found[3] == found[4] == ([], CODES)

import math

import numpy as np
from pyspark.sql import functions as F

from rxweave.llm.ann import Codebooks, search
from rxweave.llm.queries import QUERIES


def brute(rows, every=100, n=10):
    keys, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(keys % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(-1))
        d[keys == keys[i]] = np.inf
        best = [j for j in np.lexsort((keys, d))[:n] if np.isfinite(d[j])]
        out[int(keys[i])] = [(int(keys[j]), float(d[j])) for j in best]
    return out


def test_recall_on_the_whole_table(spark):
    for sf in ("sf0.01", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        want = brute([(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()])
        rows = QUERIES["op10_ann"](spark, f"/root/testdata/{sf}").collect()
        found = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found.keys() == want.keys() and all(len(found[q]) == len(want[q]) for q in want)
        assert np.mean([len({v for v, _ in found[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
        for q, near in found.items():
            assert near == sorted(near, key=lambda x: (x[1], x[0]))
            own = dict(want[q])
            assert all(math.isclose(s, own[v]) for v, s in near if v in own)


def test_ties_and_rows_that_take_no_part(spark):
    bad = [(1000, None), (1001, [0.0, 0.0]), (1002, [1.0, None]), (1003, [float("nan"), 1.0]), (1004, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(k, [1.0, 2.0]) for k in range(95, 115)] + [(7, [1.0, 2.5])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).withColumn("score", F.lit(1))
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(df).orderBy("rank").collect()]
    assert rows == [(100, n, k, 0.0) for n, k in enumerate([95, 96, 97, 98, 99, 101, 102, 103, 104, 105], 1)]


def test_vectors_of_another_length_take_no_part(spark):
    """Whichever row is first by hash: for each of many keys, one vector of that key is shorter than all others."""
    good = [(k, [float(k), 1.0]) for k in range(1, 200)]
    first = spark.createDataFrame([(k,) for k in range(1000, 1400)], "k long").orderBy(F.xxhash64("k")).first().k
    for odd in (first, 1234):
        rows = search(spark.createDataFrame([*good, (odd, [5.0, 1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
        assert len(rows) == 10 and {r.query_id for r in rows} == {100} and odd not in {r.vec_id for r in rows}


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in search(df).collect()] == [(100, 3)]
    assert search(df.limit(1)).count() == 0 and search(df.limit(0)).count() == 0


def test_codes_stand_for_the_stored_norms():
    rng = np.random.default_rng(1)
    books = Codebooks(rng.normal(size=(4, 16, 6)))
    x = rng.normal(size=(50, 6))
    codes, norms = books.encode(x)
    sums = sum(books.books[b][codes[:, b]] for b in range(4))
    assert np.allclose((sums**2).sum(-1), norms)
    greedy, _ = books.encode(x, beam=1)
    plain = sum(books.books[b][greedy[:, b]] for b in range(4))
    assert ((x - sums) ** 2).sum() <= ((x - plain) ** 2).sum() + 1e-9


def test_recall_on_many_rows_and_with_a_third_of_near_copies(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(size=(10, 64))[rng.integers(0, 10, 40_000)] + 0.5 * rng.normal(size=(40_000, 64))
    copies = x.copy()
    copies[::3] = x[0] + 1e-3 * rng.normal(size=copies[::3].shape)
    recalls = []
    for rows in (x, copies):
        table = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows), pa.list_(pa.float64()))})
        want = brute(list(enumerate(rows)), every=1000)
        found = {}
        for r in search(spark.createDataFrame(table), every=1000).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        recalls.append(np.mean([len(found[q] & {v for v, _ in want[q]}) / len(want[q]) for q in want]))
    print("recall", recalls)
    assert min(recalls) > 0.999


def test_the_result_is_that_of_sql_at_any_batch_partition_and_task_size(spark, compare):
    from rxweave.llm.queries import ORACLES

    compare(QUERIES, ORACLES, "op10_ann", "sf0.01")
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = lambda df, **sizes: sorted(map(tuple, search(df, **sizes).collect()))
    want = rows(table)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        assert rows(table.repartition(50)) == want and rows(table.coalesce(1), rows=100, queries=3) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxweave.llm.clustering import LARGEST, cluster_vectors, moved, nearest, squared
from rxweave.llm.queries import ORACLES, QUERIES


def brute(rows, dims, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cs)]
    final = [(i, *assign(v)) for i, v in kept]
    total = sum(d for _, d, _ in final)
    return sorted(((i, j, d, sum(e for _, e, h in final if h == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in final), key=repr)


def rows_of(found):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect()), key=repr)


def test_sql(compare):
    compare(QUERIES, ORACLES, "op12_clusters")


@pytest.mark.parametrize("seed", range(3))
def test_brute_force_with_ties_and_repeats(spark, seed):
    rnd = random.Random(seed)
    # few different vectors on a coarse grid: most distances tie
    grid = [[rnd.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(3)] for _ in range(25)]
    rows = [(i if rnd.random() < 0.9 else 7, rnd.choice(grid)) for i in range(200)]
    rows += [(None, [0.5, 0.5, 0.5]), (900, None), (901, [1.0, None, 1.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("-inf"), 1.0, 1.0]), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    assert rows_of(cluster_vectors(df, dims=3, k=6)) == brute(rows, 3, 6, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(cluster_vectors(df, dims=2)) == brute(rows, 2, 16, 3)
    assert cluster_vectors(df.where("false"), dims=2).count() == 0
    assert cluster_vectors(df, dims=3).count() == 0


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(df, dims=1).collect()
    edge = spark.createDataFrame([(1, [LARGEST / 64 - 1]), (2, [1 - LARGEST / 64])], "vec_id long, embedding array<double>")
    assert rows_of(cluster_vectors(edge, dims=1)) == brute([(1, [LARGEST / 64 - 1]), (2, [1 - LARGEST / 64])], 1, 16, 3)


def test_bounds_skip_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 64))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 64))
    cs = x[:16].copy()
    cluster, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 16))
    done = []
    for _ in range(5):
        done.append(nearest(x, cluster, upper, lower, cs))
        d = np.stack([squared(x, c) for c in cs], 1)
        assert (cluster == d.argmin(1)).all()
        assert (lower <= np.sqrt(d)).all() and (upper >= np.sqrt(d.min(1))).all()
        new = np.array([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else cs[j] for j in range(16)])
        moved(upper, lower, cluster, np.sqrt(squared(new, cs).astype(float)) * (1 + 1e-12))
        cs = new
    assert done[-1] < 4000 * 16 / 10

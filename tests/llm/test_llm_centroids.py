"""Operator 13 against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from llm import centroids
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    starts = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), m in zip(kept, near, strict=True) if m == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())
                   for i, d, n in found), key=repr)


def clustered(df, **options):
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=repr)


def vectors(seed, n, dims, spread=0.3, groups=6):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [m + draw.gauss(0, spread) for m in draw.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "dims", "block"), [(300, 7, 5, 64), (120, 40, 3, 4096), (30, 40, 4, 8), (50, 1, 2, 16), (200, 12, 1, 32)])
def test_equals_plain_rounds(spark, n, k, dims, block):
    rows = vectors(n, n, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert clustered(df, k=k, dims=dims, rounds=4, block=block) == plain(rows, k, 4, dims)


def test_ties_copies_and_equal_starts(spark):
    draw = random.Random(5)
    rows = [(i, [draw.randrange(3) / 2, draw.randrange(3) / 2]) for i in range(90)] + [(7, [0.5, 0.5])] * 40 + [(None, [1.0, 1.0])] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert clustered(df, k=12, dims=2, rounds=3) == plain(rows, 12, 3, 2)


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, math.nan]), (5, [math.inf, 0.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]),
            (8, [0.1, -0.1]), (9, [-0.0, 1e-9]), (10, [3e6, -3e6]), (11, [3e6, 3e6]), (12, [1.5, 1.5])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "v", "kind", "ids", "cluster", "distance")])
    assert clustered(df, k=3, dims=2, rounds=2) == plain(rows, 3, 2, 2)
    beyond_a_long = spark.createDataFrame([*rows, (13, [1e300, 0.0])], SCHEMA)
    assert clustered(beyond_a_long, k=3, dims=2, rounds=2) == plain(rows, 3, 2, 2)


def test_empty_table(spark):
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_distances():
    """After the first rounds most vectors keep their centroid without being searched for, and results do not depend on it."""
    draw = np.random.default_rng(1)
    middles = draw.integers(-200, 200, (20, 16))
    x = np.concatenate([m + draw.integers(-25, 25, (100, 16)) for m in middles]).astype(np.int64)
    near, second = np.zeros(len(x), np.int32), np.ones(len(x), np.int32)
    upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
    rows, before, searched = [list(map(int, v)) for v in x[::100]], None, []
    for _ in range(6):
        c = centroids.Centroids(rows, before)
        searched.append(centroids.assign(x, near, second, upper, lower, c))
        d = ((x[:, None, :] - c.exact[None]) ** 2).sum(-1)
        assert (near == d.argmin(1)).all()
        before, rows = rows, [[int(s) // int((near == n).sum()) for s in x[near == n].sum(0)] for n in range(20)]
    assert searched[0] >= 0.9 * len(x)  # those of the first centroid can be settled by half its distance to the next
    assert searched[-1] < len(x) / 10

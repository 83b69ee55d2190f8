"""Clustering by Shallot search against comparing every vector with every centroid."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlake.llm import clustering

DIMS = 6


def brute(rows, k, rounds, dims=DIMS, seed=2):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, tuple(int(np.floor(256.0 * x)) for x in v)))
    def order(r):
        return (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=order)[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        got = assign()
        for i in range(len(cents)):
            mine = [v for (_, v), (_, j) in zip(kept, got) if i == j]
            if mine:
                cents[i] = tuple(sum(x) // len(mine) for x in zip(*mine))
    got = assign()
    total = sum(d for d, _ in got)
    inertia = {i: sum(d for d, j in got if j == i) for i in range(len(cents))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(vec_id), i, d, inertia[i], total, digests[i]) for (vec_id, _), (d, i) in zip(kept, got))


def run(spark, rows, kind="double", parts=3, **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as vector", "1 as first", "2 as cluster")
    out = clustering.clustered(df.repartition(parts), dims=DIMS, **options)
    assert out.columns[:4] == ["vec_id", "embedding", "vector", "first"]
    assert all(r["vector"] == "x" and r["first"] == 1 for r in out.select("vector", "first").distinct().collect())
    keep = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.select(*keep).collect())


def rows_of(n, seed, spread=3):
    """Vectors on a coarse grid: many ties between centroids, many repeated vectors."""
    r = random.Random(seed)
    return [(i, [r.randint(-spread, spread) / 2 for _ in range(DIMS)]) for i in range(n)]


@pytest.mark.parametrize("n,k,spread", [(150, 12, 1), (200, 25, 3), (60, 40, 40), (7, 12, 2), (1, 3, 1)])
def test_equals_comparing_all(spark, n, k, spread):
    rows = rows_of(n, n + k, spread)
    assert run(spark, rows, k=k, rounds=4) == brute(rows, k, 4)


def test_vectors_that_are_not_kept_and_ties_of_ids(spark):
    rows = rows_of(30, 5) + [(31, None), (32, []), (33, [0.5] * (DIMS - 1)), (34, [0.5] * (DIMS + 1)), (35, [None] + [0.5] * (DIMS - 1))]
    rows += [(36, [float("nan")] + [0.0] * (DIMS - 1)), (37, [float("-inf")] + [0.0] * (DIMS - 1)), (None, [0.25] * DIMS), (3, [-0.25] * DIMS), (3, [-0.25] * DIMS)]
    assert run(spark, rows, k=9, rounds=3) == brute(rows, 9, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[2**22 + 1] * DIMS, [2**22 + 2] * DIMS, [-(2**22)] * DIMS, [2**22 + 1, 0, 0, 0, 0, 0]])]
    assert run(spark, rows, k=3, rounds=2) == brute(rows, 3, 2)
    far = [(1, [1e18] + [0.0] * (DIMS - 1)), (2, [0.0] * DIMS), (3, [1e10] + [0.0] * (DIMS - 1))]  # the first is beyond 64 bits
    got = run(spark, far, k=1, rounds=1)
    assert [r[0] for r in got] == ["2", "3"] and got[0][2] is None  # squared distance beyond 64 bits


def test_layout_does_not_matter_and_empty_tables(spark):
    rows = rows_of(90, 8)
    assert run(spark, rows, kind="float", parts=1, k=10) == run(spark, rows, kind="float", parts=8, k=10)
    assert run(spark, [], k=10) == []
    assert run(spark, [(1, None)], k=10) == []


def test_bounds_spare_comparisons_and_change_nothing():
    r = np.random.default_rng(3)
    vectors = r.integers(-300, 300, (500, 8))
    cents = vectors[:30].copy()
    near = clustering.Neighbours(cents)
    state = {"vectors": vectors, "first": np.zeros(500, np.int32), "second": np.zeros(500, np.int32), "upper": np.full(500, np.inf), "lower": np.full(500, -np.inf)}
    state |= clustering.assigned(state, near, None)
    everything = ((vectors[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (state["first"] == everything.argmin(axis=1)).all()
    assert (state["lower"] <= np.sqrt(np.sort(everything, axis=1)[:, 1])).all()
    moved = cents + r.integers(-1, 2, cents.shape)
    away = np.sqrt(((moved - cents) ** 2).sum(axis=1).astype(float))
    again = clustering.assigned(state, clustering.Neighbours(moved), away)
    assert (again["first"] == ((vectors[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    widened = state["upper"] + away[state["first"]]
    assert (again["upper"] == widened).mean() > 0.3  # survivors are the smaller part

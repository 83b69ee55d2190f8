"""Centroid clustering in integers by Shallot search.

Every vector carries bounds from round to round: the centroid that it belongs
to, the second nearest of the last search, an upper bound of its distance to
the first and a lower bound of its distance to any other. When centroids have
moved, the bounds are widened by their moves, and a vector whose upper bound
stays below its lower bound keeps its centroid unseen. The others are survivors:

1. the distances to the first and the second centroid are taken, and the search
   starts from the closer one, s, at distance u; the other one, at distance v,
   is the second best so far;
2. the neighbours of s are visited from near to far. A centroid that is nearer
   than v must lie within u + v of s, so the ball ends there, and it shrinks as
   soon as a better second is found;
3. candidates are compared by exact squared distances in integers, and by their
   numbers where those are equal.

So the result is that of comparing every vector with every centroid. The state
of a round is a table written to the shared folder; centroids (at most ``k``
vectors) are the only thing that tasks are sent and that the driver gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

SCALE = 256
PART = 8192  # vectors worked on at a time
SLACK = 1e-9  # how much bounds are widened for rounding


def whole_numbers(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), taken as double; null where that is no 64-bit integer."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * F.lit(float(scale))))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float(1 << 62)), F.floor(x).cast("long"))  # not so for NaN, which is above all


def exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or as Python's where squared distances could pass 64 bits."""
    most = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * vectors.shape[1] < 1 << 62:
        return vectors, centroids
    return vectors.astype(object), centroids.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, row by row."""
    away = a - b
    return (away * away).sum(axis=1) if away.dtype == object else np.einsum("ij,ij->i", away, away)


def lengths(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


class Neighbours:
    """Centroids with their distances to each other, nearest first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        x, _ = exact(centroids, centroids)
        self.between = np.array([lengths(squared(x, row)) for row in x]).reshape(len(x), len(x))
        self.order = np.argsort(self.between, axis=1, kind="stable")


def shallot(vectors: np.ndarray, first: np.ndarray, second: np.ndarray, near: Neighbours) -> tuple[np.ndarray, ...]:
    """(nearest, its squared distance, second nearest, its squared distance) of every vector."""
    vectors, c = exact(vectors, near.centroids)
    d1, d2 = squared(vectors, c[first]), squared(vectors, c[second])
    if len(c) == 1:
        return first, d1, second, d2
    swap = (d2 < d1) | ((d2 == d1) & (second < first))
    best, other = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, given = best.copy(), other.copy()
    u = lengths(d1)
    for s in np.unique(start):
        rows = np.flatnonzero(start == s)
        for j in near.order[s]:
            ball = (u[rows] + lengths(d2[rows])) * (1 + SLACK)
            rows = rows[near.between[s, j] * (1 - SLACK) <= ball]  # sorted neighbours: who is done stays done
            if not len(rows):
                break
            at = rows[given[rows] != j]
            if j == s or not len(at):
                continue
            d = squared(vectors[at], c[j])
            first_now = (d < d1[at]) | ((d == d1[at]) & (j < best[at]))
            second_now = ~first_now & ((d < d2[at]) | ((d == d2[at]) & (j < other[at])))
            up = at[first_now]
            d2[up], other[up] = d1[up], best[up]
            d1[up], best[up] = d[first_now], j
            d2[at[second_now]], other[at[second_now]] = d[second_now], j
    return best, d1, other, d2


def assigned(state: dict[str, np.ndarray], near: Neighbours, moved: np.ndarray | None) -> dict[str, np.ndarray]:
    """The state of some vectors (vectors, first, second, upper, lower) for the centroids as they are now."""
    first, second = state["first"].copy(), state["second"].copy()
    second = np.where(second == first, (first + 1) % len(near.centroids), second)
    upper, lower = state["upper"].copy(), state["lower"].copy()
    if moved is not None:
        far = np.argsort(-moved, kind="stable")[:2]
        upper += moved[first]
        lower -= np.where(first == far[0], moved[far[1]] if len(far) > 1 else 0.0, moved[far[0]])
    left = np.flatnonzero(~(upper * (1 + SLACK) + SLACK < lower))
    for lo in range(0, len(left), PART):
        at = left[lo : lo + PART]
        first[at], d1, second[at], d2 = shallot(state["vectors"][at], first[at], second[at], near)
        upper[at], lower[at] = lengths(d1) * (1 + SLACK), lengths(d2) * (1 - SLACK)
    return {"first": first, "second": second, "upper": upper, "lower": lower}


STATE = "vector array<bigint>, first int, second int, upper double, lower double"


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    near = Neighbours(centroids)
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("vector")
        vectors = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
        fields = {n: batch.column(at + 1 + i).to_numpy() for i, n in enumerate(("first", "second", "upper", "lower"))}
        new = assigned({"vectors": vectors} | fields, near, moved)
        arrays = [pa.array(new["first"], pa.int32()), pa.array(new["second"], pa.int32()), pa.array(new["upper"]), pa.array(new["lower"])]
        names = ["first", "second", "upper", "lower"]
        if last:
            v, c = exact(vectors, centroids)
            d = squared(v, c[new["first"]])
            arrays = [arrays[0], pa.array([int(x) if x < 1 << 63 else None for x in d.tolist()], pa.int64())]
            names = ["first", "distance"]
        keep = batch.columns[: at + (not last)]
        yield pa.RecordBatch.from_arrays([*keep, *arrays], names=[*batch.schema.names[: len(keep)], *names])


def _floor_means(state: DataFrame, dims: int) -> dict[int, list[int]]:
    """Componentwise exact floor(sum / count) of every cluster that has vectors: at most k rows reach the driver."""
    sums = [F.sum(F.col("vector")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = state.groupBy("first").agg(F.count("*").alias("n"), *sums).collect()
    return {r["first"]: [int(r[f"s{i}"]) // r["n"] for i in range(dims)] for r in rows}


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clustered(
    rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2,
    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The rows whose vector is kept, with cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256.

    A vector is kept if it has exactly ``dims`` components, none of them null,
    not finite, or beyond 64 bits once scaled; each becomes floor(scale * x).
    The first centroids are the ``k`` kept vectors with the smallest sha256 of
    ``<seed>:<id>`` (a null id comes last; equal ids by their vectors). Each of
    ``rounds`` rounds assigns all vectors, ties to the smaller number, and
    replaces every centroid that has vectors by the floor of their mean; then
    vectors are assigned once more. Repeated rows count as often as they occur;
    with fewer than k vectors there are as many centroids; no vector kept, no
    row. Distances or sums beyond 64 bits are null. Columns of the six names
    are replaced; all others are kept.
    """
    out_names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    spark, rows = rows.sparkSession, rows.drop(*out_names)
    n_columns = len(rows.columns)
    plain = rows.toDF(*[f"c{i}" for i in range(n_columns)])  # working names cannot clash with theirs
    names = {n: f"c{i}" for i, n in enumerate(rows.columns)}
    whole = plain.withColumn("vector", whole_numbers(F.col(names[vector_col]), scale))
    right = (F.size(names[vector_col]) == dims) & ~F.exists("vector", lambda x: x.isNull())
    start = whole.filter(F.coalesce(right, F.lit(False))).select(
        *plain.columns, "vector", F.lit(0).alias("first"), F.lit(0).alias("second"),
        F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"),
    )
    state = stored(start, "cluster-start")
    kind = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain.columns, rows.schema.fields, strict=True))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(names[id_col]).cast("string")), 256)
    chosen = state.select(digest.alias("d"), "vector").orderBy(F.col("d").asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.array([r["vector"] for r in chosen], np.int64).reshape(-1, dims)
    moved = None
    for _ in range(rounds if len(centroids) else 0):
        step = lambda batches, c=centroids, m=moved: _round(batches, c, m, False)
        new = stored(state.mapInArrow(step, f"{kind}, {STATE}"), "cluster-round")
        means = _floor_means(new, dims)
        at = np.array([means.get(i, c.tolist()) for i, c in enumerate(centroids)], np.int64)
        moved, centroids = lengths(squared(*exact(at, centroids))) * (1 + SLACK), at
        dropped(spark, state)
        state = new
    last = lambda batches, c=centroids, m=moved: _round(batches, c, m, True)
    found = stored(state.mapInArrow(last, f"{kind}, first int, distance bigint"), "clusters")
    dropped(spark, state)
    d = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("first").agg(d.alias("s")).collect()  # at most k rows
    as_long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = as_long(sum(r["s"] or 0 for r in sums))
    by = {r["first"]: as_long(r["s"]) for r in sums}
    facts = spark.createDataFrame(
        [(i, by.get(i), total, [int(x) for x in c], centroid_digest(c)) for i, c in enumerate(centroids)],
        "first int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string",
    )
    kept = [F.col(names[n]).alias(n) for n in rows.columns]
    return found.join(F.broadcast(facts), "first").select(  # k rows
        *kept, F.col("first").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )

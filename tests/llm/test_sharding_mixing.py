"""Feistel sharding and source mixing."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from documents_fixture import docs_of  # noqa: F401
from ledgerlake.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 100, 257, 1009])
def test_places_are_a_permutation_and_match_the_column(spark, n):
    places = [sharding.place_of(i, n, 5) for i in range(n)]
    assert sorted(slot * 5 + shard for shard, slot in places) == list(range(n))
    got = spark.range(n).select("id", sharding.permuted_number(F.col("id"), n).alias("p")).collect()
    assert {r.id: (r.p % 5, r.p // 5) for r in got} == dict(enumerate(places))


def test_grid_covers_every_size():
    for n in [1, 2, 5, 1000, 10**6 + 3, 10**11 + 7]:
        a, b = sharding.grid(n)
        assert a * b >= n and a * b - n < math.isqrt(n) + 1


def test_walks_end_within_the_range(spark):
    n = next(n for n in range(2000, 4000) if math.prod(sharding.grid(n)) > n)
    got = spark.range(n).select(sharding.permuted_number(F.col("id"), n).alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(got) == (n, 0, n - 1)


def test_shards_of_a_table(docs_of):
    rows = [(None, "a"), (None, None), (3, ""), (3, "x"), (3, "x")] + [(i, f"t{i}") for i in range(4, 60)]
    random.Random(1).shuffle(rows)
    one = sharding.shard(docs_of(rows), 7, ["doc_id", F.xxhash64("text")])
    two = sharding.shard(docs_of(rows[::-1]).repartition(5), 7, ["doc_id", F.xxhash64("text")])
    key = lambda df: sorted((r.doc_id or -1, r.text or "", r.row_number, r.shard, r.slot) for r in df.collect())
    assert key(one) == key(two)
    assert set(docs_of(rows).columns) <= set(one.columns)
    by = {}
    for r in one.collect():
        by.setdefault(r.shard, []).append(r.slot)
        assert (r.shard, r.slot) == sharding.place_of(r.row_number, len(rows), 7)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(i, [])) for i in range(7)) <= 1
    assert sharding.shard(docs_of([]), 7, ["doc_id"]).count() == 0


def test_query_shards_whole_table(spark):
    got = E.queries()["op10_feistel_shards"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))


def waterfill(sizes, weights, share=1.5, limit=2.0):
    goal, full = share * sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in full}
        left = goal - sum(full.values())
        targets = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = {s: limit * sizes[s] for s, t in targets.items() if t > limit * sizes[s]}
        if not over:
            return full | targets
        full |= over


def test_targets_and_copies(docs_of):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 300)), s) for i, s in enumerate(["b", "a", "é", "z", None, "hot", "hot", "hot"] * 60)]
    rows += [(1000, None, "a"), (1001, " \n ", "empty"), (1002, "x", "tiny"), (None, "y z", "a"), (5, rows[5][1], rows[5][2])]
    out = mixing.mixed(docs_of(rows)).collect()
    sizes, taken, target = {}, {}, {}
    for x in out:
        assert x["size"] == len((x.text or "").split())
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
        taken[x.source] = taken.get(x.source, 0) + x["size"] * x.copies
        target[x.source] = x.target
        assert x.copies <= 2 and x.source_size is not None
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = waterfill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and target[s] <= 2 * sizes[s]
        if sizes[s] > 5000:
            assert taken[s] == pytest.approx(target[s], rel=0.15)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mixed(docs_of(rows[::-1])).collect()
    assert sorted((x.doc_id or -1, x.copies) for x in out) == sorted((x.doc_id or -1, x.copies) for x in again)


def test_mix_emits_copies_with_all_columns(docs_of):
    docs = docs_of([(i, "a b c", "s" if i % 3 else None) for i in range(90)])
    out = mixing.emitted(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    assert out.groupBy("doc_id").count().collect() and {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    assert mixing.emitted(docs_of([])).count() == 0 and mixing.emitted(docs_of([(1, None)])).count() == 0

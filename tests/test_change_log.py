"""A log of changes folded at once equals applying its changes one after another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import store as ST

KIND = "op string, budget_id string, category string, monthly_limit double, applies_from string, notes string, changed_at timestamp, seq int"
PLANS = "budget_id string, category string, monthly_limit double, applies_from string, notes string, created_at timestamp, updated_at timestamp"
FIELDS = ST.PLAN_FIELDS


def sequential(plans, log):
    state = {p[0]: dict(zip((*FIELDS, "created_at", "updated_at"), p[1:])) for p in plans}
    for op, key, *values, at, _ in sorted(log, key=lambda c: (c[-2], c[-1])):
        carried = {f: v for f, v in zip(FIELDS, values) if v is not None}
        if op == "delete":
            state.pop(key, None)
        elif op == "create" and key not in state:
            state[key] = {f: None for f in FIELDS} | carried | {"created_at": at, "updated_at": None}
        elif key in state and op in ("create", "update"):
            state[key] |= carried | {"updated_at": at}
    return sorted((k, *v.values()) for k, v in state.items())


def run(spark, plans, log):
    out = ST.apply_plan_changes(spark.createDataFrame(plans, PLANS), spark.createDataFrame(log, KIND).repartition(5), tie=["seq"])
    assert out.columns == ["budget_id", *FIELDS, "created_at", "updated_at"]
    return sorted(tuple(r) for r in out.collect())


def when(minute):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)


def test_create_and_update_in_one_batch(spark):
    log = [("create", "p", "Food", 10.0, None, None, when(1), 0), ("update", "p", None, 20.0, None, None, when(2), 0),
           ("update", "p", None, None, None, "a note", when(3), 0)]
    assert run(spark, [], log) == [("p", "Food", 20.0, None, "a note", when(1), when(3))]


def test_delete_and_create_again_takes_nothing_over(spark):
    plans = [("p", "Food", 10.0, "2024-01", "old", when(0), when(0))]
    log = [("update", "p", None, 99.0, None, None, when(1), 0), ("delete", "p", None, None, None, None, when(2), 0),
           ("update", "p", "lost", None, None, None, when(3), 0), ("create", "p", None, 5.0, None, None, when(4), 0)]
    assert run(spark, plans, log) == [("p", None, 5.0, None, None, when(4), None)]
    assert run(spark, plans, log[:3]) == []


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_after_another(spark, seed):
    r = random.Random(seed)
    plans = [(f"k{i}", "c", 1.0, None, "n", when(-9), None) for i in range(0, 30, 2)]
    log = []
    for i in range(400):
        some = lambda v: v if r.random() < 0.5 else None
        log.append((r.choice(["create", "update", "update", "delete"]), f"k{r.randint(0, 34)}", some(f"c{i}"), some(float(i)),
                    some(f"f{i}"), some(f"n{i}"), when(r.randint(0, 60)), i))
    assert run(spark, plans, log) == sequential(plans, log)


def test_no_window_and_no_collected_list(spark):
    text = ST.apply_plan_changes(spark.createDataFrame([], PLANS), spark.createDataFrame([], KIND))._jdf.queryExecution().toString()
    assert "Window" not in text and "collect_list" not in text


def test_upsert_without_an_order_rejects_contradictions(spark):
    cur = spark.createDataFrame([("a", 1)], "k string, v int")
    same = spark.createDataFrame([("a", 2), ("a", 2), ("b", None), ("b", None)], "k string, v int")
    assert sorted(map(tuple, ST.upsert(cur, same, ["k"]).collect()), key=str) == [("a", 2), ("b", None)]
    with pytest.raises(Exception, match="updates of one key differ"):
        ST.upsert(cur, spark.createDataFrame([("a", 2), ("a", 3)], "k string, v int"), ["k"]).collect()
    by = spark.createDataFrame([("a", 2, 5), ("a", 3, 4)], "k string, v int, t int").repartition(2)
    assert ST.upsert(cur.withColumn("t", F.lit(0)), by, ["k"], order_by="t").first().v == 2

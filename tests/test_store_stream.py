"""Upserts, parquet tables, plan change-sets, and streaming equals batch."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import summary as S
from ledgerlake.session import scratch_path
from ledgerlake.sources import store as ST
from ledgerlake.sources import testdata as TD
from ledgerlake.streaming import ingest as IN

SF = "/root/testdata/sf0.001"


def test_upsert_idempotent_and_counts(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    upd = spark.createDataFrame([("b", 20.0), ("c", 3.0)], "k string, v double")
    once = ST.upsert(cur, upd, ["k"])
    twice = ST.upsert(once, upd, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.k: r.v for r in once.collect()} == {"a": 1.0, "b": 20.0, "c": 3.0}
    flags = {r.k: r.op for r in ST.upsert(cur, upd, ["k"], flag="op").collect()}
    assert flags == {"a": "kept", "b": "updated", "c": "inserted"}
    dup = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2)], "k string, v double, t int")
    latest = ST.upsert(cur.withColumn("t", F.lit(0)), dup, ["k"], order_by="t")
    assert {r.k: r.v for r in latest.collect()}["b"] == 6.0


def _files(spark, root):
    return {r.value for r in spark.read.parquet(root).select(F.input_file_name().alias("value")).distinct().collect()}


def test_parquet_table_append_and_upsert(spark):
    root = scratch_path(spark, "tbl")
    df = spark.createDataFrame([("x", "2025-01", 1), ("y", "2025-01", 2)], "transaction_id string, year_month string, n int")
    ST.replace_table(df, root, ["year_month"])
    before = _files(spark, root)
    # y comes again under another month: still the same id, so it is not appended
    ST.append_table(spark.createDataFrame([("y", "2025-02", 9), ("z", "2025-02", 3)], df.schema), root, partition_by=["year_month"])
    assert sorted((r.transaction_id, r.n) for r in ST.read_current(spark, root).collect()) == [("x", 1), ("y", 2), ("z", 3)]
    assert before <= _files(spark, root)   # an append rewrites nothing

    root = scratch_path(spark, "upserts")
    ST.upsert_table(df, root, ["transaction_id"], buckets=64)
    before = _files(spark, root)
    moved = spark.createDataFrame([("y", "2025-07", 20), ("w", "2025-07", 4), ("y", "2025-08", 21)], df.schema)
    res = ST.upsert_table(moved, root, ["transaction_id"], order_by="n")
    assert (res["inserted"], res["updated"]) == (1, 1)
    got = sorted(tuple(r) for r in ST.read_current(spark, root).select("transaction_id", "year_month", "n").collect())
    assert got == [("w", "2025-07", 4), ("x", "2025-01", 1), ("y", "2025-08", 21)]   # moved once, the last update wins
    assert len(before & _files(spark, root)) >= 1   # the other bucket stays as it is
    ST.upsert_table(moved, root, ["transaction_id"], order_by="n")   # idempotent
    assert ST.read_current(spark, root).count() == 3


def test_buckets_follow_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(ST, "BUCKET_ROWS", 10)
    root = scratch_path(spark, "grows")
    rows = lambda lo, hi, v: spark.range(lo, hi).selectExpr("cast(id as string) k", f"{v} as v")
    ST.upsert_table(rows(0, 25, 1), root, ["k"])
    assert ST._layout(spark, root) == 3
    ST.upsert_table(rows(20, 300, 2), root, ["k"])
    assert ST._layout(spark, root) == 12 and len(set(r[0] for r in spark.read.parquet(root).select(ST.BUCKET).distinct().collect())) == 12
    want = {str(i): 1 if i < 20 else 2 for i in range(300)}
    assert {r.k: r.v for r in ST.read_current(spark, root).collect()} == want
    # a job lost while the table is dealt anew: the next one goes on from the staged copy
    whole = ST.write_rows

    def lost(df, path, *args, **kw):
        raise OSError("lost")

    monkeypatch.setattr(ST, "write_rows", lost)
    with pytest.raises(OSError):  # after the staged copy is finished and the old buckets are gone
        ST._dealt_anew(spark, root, ["k"], 5)
    assert ST.read_or_none(spark, root) is None
    monkeypatch.setattr(ST, "write_rows", whole)
    ST.upsert_table(rows(299, 301, 3), root, ["k"])
    assert ST._layout(spark, root) == 20  # 5, as staged; then four times as many, as the table has outgrown them
    assert {r.k: r.v for r in ST.read_current(spark, root).collect()} == want | {"299": 3, "300": 3}


def test_upsert_is_field_wise_and_last_wins(spark):
    cur = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "keep")], "k string, v int, note string")
    upd = spark.createDataFrame([("b", 5), ("c", 7), ("b", 6)], "k string, v int")
    got = sorted(tuple(r) for r in ST.upsert(cur, upd, ["k"], order_by="v").collect())
    assert got == [("a", 1, "keep"), ("b", 6, "keep"), ("c", 7, None)]
    flags = {r.k: r.op for r in ST.upsert(cur, upd, ["k"], order_by="v", flag="op").collect()}
    assert flags == {"a": "kept", "b": "updated", "c": "inserted"}


def test_merge_sql_parses(spark):
    sql = ST.merge_sql("db.t", "u", ["k"], ["k", "v"])
    spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    assert "WHEN MATCHED THEN UPDATE SET t.`v` = s.`v`" in sql


def test_read_or_none_only_hides_missing_data(spark, tmp_path):
    assert ST.read_or_none(spark, str(tmp_path / "absent")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ST.read_or_none(spark, str(tmp_path / "bad"))


def test_partitioned_write_makes_few_files(spark):
    root = scratch_path(spark, "files")
    df = spark.range(4000).select(F.col("id").cast("string").alias("transaction_id"),
                                  F.concat(F.lit("2025-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("year_month"))
    ST.replace_table(df.repartition(16), root, ["year_month"])
    assert len(_files(spark, root)) <= 12 * 2


def test_saved_records(spark):
    root = scratch_path(spark, "records")
    rows = spark.createDataFrame([("r", '{"a": 1}'), ("s", "not json")], "report_type string, payload string")
    ST.save_records(rows, root, "report_id", ["payload"])
    ST.save_records(rows.limit(1), root, "report_id", ["payload"])
    got = ST.with_variant(spark.read.parquet(root), ["payload"])
    assert got.count() == 3 and got.select("report_id").distinct().count() == 3
    assert got.where("created_at is null").count() == 0 and got.where("payload is null").count() == 1


def test_upsert_partitions_rewrites_touched_months_only(spark):
    root = scratch_path(spark, "parts")
    keys = ["entity", "year_month"]
    base = spark.createDataFrame([(f"e{i}", f"2025-0{1 + i % 3}", float(i)) for i in range(30)],
                                 "entity string, year_month string, amount double")
    ST.upsert_partitions(base, root, keys)
    before = _files(spark, root)
    upd = spark.createDataFrame([("e1", "2025-02", 100.0), ("new", "2025-02", 5.0)], base.schema)
    ST.upsert_partitions(upd, root, keys)
    out = spark.read.parquet(root)
    assert out.count() == 31 and out.where("entity = 'e1'").collect()[0].amount == 100.0
    assert {f for f in before if "2025-02" not in f} <= _files(spark, root)   # other months were not rewritten
    ST.upsert_partitions(upd, root, keys)   # idempotent
    assert spark.read.parquet(root).count() == 31
    with pytest.raises(ValueError):
        ST.upsert_partitions(base, root, ["entity"])


def test_plan_changes_and_latest(spark):
    t = "timestamp"
    plans = spark.createDataFrame([("p1", "Food", 100.0, None, None)], "budget_id string, category string, monthly_limit double, applies_from string, notes string") \
        .withColumn("created_at", F.lit("2025-01-01").cast(t)).withColumn("updated_at", F.lit(None).cast(t))
    ch = spark.createDataFrame([
        ("update", "p1", None, 150.0, None, "more", "2025-02-01"),
        ("create", "p2", "Cafe", 50.0, None, None, "2025-02-02"),
        ("create", "p3", "Taxi", 20.0, None, None, "2025-02-02"),
        ("delete", "p3", None, None, None, None, "2025-02-03"),
        ("update", "p9", "Nope", 1.0, None, None, "2025-02-03"),
    ], "op string, budget_id string, category string, monthly_limit double, applies_from string, notes string, changed_at string") \
        .withColumn("changed_at", F.col("changed_at").cast(t))
    out = {r.budget_id: r for r in ST.apply_plan_changes(plans, ch).collect()}
    assert set(out) == {"p1", "p2"}
    assert out["p1"].monthly_limit == 150.0 and out["p1"].category == "Food" and out["p1"].notes == "more"
    assert out["p1"].updated_at is not None and out["p2"].created_at is not None
    ev = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "u int, ts int, x string")
    assert {r.u: r.x for r in ST.latest_per_key(ev, ["u"], ts="ts").collect()} == {1: "b", 2: "c"}
    assert [r.x for r in ST.newest_n(ev, 2, ts="ts").collect()] == ["b", "a"]


def test_first_non_empty(spark):
    empty = spark.createDataFrame([], "a int")
    full = spark.createDataFrame([(1,)], "a int")

    def broken():
        raise RuntimeError("store down")

    assert ST.first_non_empty([broken, lambda: empty, lambda: full]).collect() == [(1,)]


def _arrivals(spark):
    """Four files: recent events; later ones with repeats; old ones (late by any watermark) with repeats; old repeats."""
    src = tempfile.mkdtemp(prefix="ll-src-")
    ev = pq.read_table(f"{SF}/events.parquet")
    ts = ev.schema.field("ts").type
    cut = lambda day: pa.scalar(dt.datetime.fromisoformat(day), type=ts)
    late = ev.filter(pc.less(ev["ts"], cut("2024-01-10")))
    mid = ev.filter(pc.and_(pc.greater_equal(ev["ts"], cut("2024-01-10")), pc.less(ev["ts"], cut("2024-01-20"))))
    recent = ev.filter(pc.greater_equal(ev["ts"], cut("2024-01-20")))
    assert min(late.num_rows, mid.num_rows, recent.num_rows) > 50
    files = [recent, pa.concat_tables([mid, recent.slice(0, 50), mid.slice(0, 20)]),
             pa.concat_tables([late.slice(100), mid.slice(0, 50)]), pa.concat_tables([late, recent.slice(0, 30)])]
    for i, f in enumerate(files):
        pq.write_table(f, os.path.join(src, f"{i}.parquet"))
        os.utime(os.path.join(src, f"{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = lambda: TD.events_to_ledger(IN.file_stream(spark, src, schema, "*.parquet", max_files_per_trigger=1))
    return ev.num_rows, stream


COLS = ["entity_id", "year_month", "total_income", "total_expense", "net", "transaction_count"]


def test_streams_lose_nothing_and_double_nothing(spark):
    n, stream = _arrivals(spark)
    root = scratch_path(spark, "streams")
    want = sorted(tuple(r) for r in S.monthly_summary(TD.events_ledger(spark, SF), by=["entity_id"]).select(*COLS).collect())
    IN.run_to_completion(lambda: IN.start_append_dedup(stream(), f"{root}/t", f"{root}/ck1"))
    got = spark.read.parquet(f"{root}/t")
    assert got.select("batch_id").distinct().count() >= 3
    assert got.count() == n and got.select("transaction_id").distinct().count() == n
    IN.run_to_completion(lambda: IN.start_monthly_summary(stream(), f"{root}/s", f"{root}/ck2", by=["entity_id"]))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/s").select(*COLS).collect()) == want
    IN.run_to_completion(lambda: IN.start_ingest(stream(), f"{root}/it", f"{root}/is", f"{root}/ck3", by=["entity_id"]))
    assert spark.read.parquet(f"{root}/it").count() == n
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/is").select(*COLS).collect()) == want

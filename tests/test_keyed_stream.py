"""Keyed state of the append stream, and folding of its folders: retries and crashes lose and double nothing."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import summary as S
from ledgerlake.session import scratch_path
from ledgerlake.sources import folders as FO
from ledgerlake.streaming import ingest as IN

KIND = "transaction_id string, year_month string, type string, amount decimal(18,2), entity_id long"


def rows(spark, ids, month="2025-01"):
    full = [(str(i), f"2025-{i % 3 + 1:02d}" if month is None else month, "Income" if i % 2 else "Expense", i, i % 4) for i in ids]
    return spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in full], KIND.replace("decimal(18,2)", "long")).withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))


def stream_of(spark, source, per_trigger=None):
    return IN.file_stream(spark, source, rows(spark, [1]).schema, max_files_per_trigger=per_trigger)


def ids_of(spark, root):
    return sorted(int(r.transaction_id) for r in IN.read_batches(spark, root).select("transaction_id").collect())


def run(spark, source, root, **more):
    started = []

    def start():
        started.append(IN.start_append_dedup(stream_of(spark, source), f"{root}/t", f"{root}/ck", **more))
        return started[0]

    IN.run_to_completion(start)
    return [json.loads(p.json) for p in started[0].recentProgress]


def test_a_batch_reads_nothing_of_the_table(spark):
    source, root = scratch_path(spark, "src"), scratch_path(spark, "keyed")
    rows(spark, range(3000)).repartition(12).write.parquet(source)
    run(spark, source, root)
    rows(spark, range(2500, 3500)).write.mode("append").parquet(source)
    progress = [p for p in run(spark, source, root) if p["numInputRows"]]
    assert sum(p["numInputRows"] for p in progress) == 1000  # the new file alone: no key of the table is read
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 3500
    assert "RocksDB" in json.dumps(progress[-1]["stateOperators"][0]["customMetrics"]) or "rocksdb" in json.dumps(progress[-1]["stateOperators"][0])
    assert ids_of(spark, f"{root}/t") == list(range(3500))


def test_state_starts_from_an_existing_table(spark):
    source, root = scratch_path(spark, "src"), scratch_path(spark, "seeded")
    rows(spark, range(0, 60)).write.parquet(source)
    run(spark, source, root)  # an earlier stream, whose checkpoint is lost
    again, other = scratch_path(spark, "src"), rows(spark, range(200, 210))
    rows(spark, list(range(40, 100)) * 2).repartition(3).write.parquet(again)
    rows(spark, range(195, 220)).write.mode("append").parquet(again)

    def start():
        return IN.start_append_dedup(stream_of(spark, again, 1), f"{root}/t", f"{root}/ck2", known=other)

    IN.run_to_completion(start)
    want = [*range(100), *range(195, 200), *range(210, 220)]  # those of the other table are known, wherever they are
    assert ids_of(spark, f"{root}/t") == want
    rows(spark, [5, 99, 205, 300]).write.mode("append").parquet(again)
    IN.run_to_completion(start)
    assert ids_of(spark, f"{root}/t") == [*want, 300]


def test_a_retried_batch_replaces_itself(spark):
    source, root = scratch_path(spark, "src"), scratch_path(spark, "retried")
    rows(spark, range(20)).write.parquet(source)
    run(spark, source, root)
    rows(spark, range(10, 40)).write.mode("append").parquet(source)
    sink = IN._append_batch(f"{root}/t", "transaction_id", None, 0, 10)

    def broken(batch, batch_id):
        sink(batch, batch_id)
        raise RuntimeError("lost after the write")

    stream = IN.first_of_each_key(stream_of(spark, source), "transaction_id", None)
    q = IN._started(stream, broken, f"{root}/ck", True, None)
    with pytest.raises(Exception, match="lost after the write"):
        q.awaitTermination()
    run(spark, source, root)
    assert ids_of(spark, f"{root}/t") == list(range(40))


def batches(spark, n):
    """Batch k holds two new rows."""
    return [rows(spark, [2 * k, 2 * k + 1], None).withColumn(IN.SEED, F.lit(False)) for k in range(n)]


@pytest.mark.parametrize("broken", [None, "delete", "move"])
def test_folders_stay_few_and_rows_whole(spark, monkeypatch, broken):
    """A crash at any step of folding: the same batch comes again and goes on."""
    root = scratch_path(spark, "folded")
    sink = IN._append_batch(root, "transaction_id", None, 0, 3)
    whole = getattr(FO, broken) if broken else None
    for k, batch in enumerate(batches(spark, 20)):
        if broken and k in (9, 18):
            calls = []

            def fails(*args):
                calls.append(args)
                if len(calls) == 2 - (broken == "move"):
                    raise OSError("lost")
                return whole(*args)

            monkeypatch.setattr(FO, broken, fails)
            with pytest.raises(OSError):
                sink(batch, k)
            monkeypatch.setattr(FO, broken, whole)
            assert ids_of(spark, root) == list(range(2 * k))  # readers see every row once while folders are being folded
        sink(batch, k)
        assert ids_of(spark, root) == list(range(2 * k + 2))
        assert len(FO.numbered(spark, root, "batch_id")) <= 3 * 3
    assert FO.numbered(spark, root, "batch_id") == [8, 17, 18, 19]


def test_sums_stay_few_and_the_summary_equals_the_batch_answer(spark):
    root = scratch_path(spark, "summed")
    sink = IN._ingest_batch(f"{root}/t", f"{root}/s", "transaction_id", ["entity_id"], None, 0, 4)
    every = None
    for k, batch in enumerate(batches(spark, 14)):
        sink(batch, k)
        if k in (4, 8, 13):
            sink(batch, k)  # a retry, of batches that fold as well
        every = batch if every is None else every.unionByName(batch)
        assert len(FO.numbered(spark, f"{root}/s/_sums", "batch")) <= 4 and len(FO.numbered(spark, f"{root}/s/_sums", "upto")) <= 1
    columns = ["entity_id", "year_month", "total_income", "total_expense", "net", "transaction_count"]
    want = sorted(tuple(r) for r in S.monthly_summary(every.drop(IN.SEED), by=["entity_id"]).select(*columns).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/s").select(*columns).collect()) == want


def test_summary_over_a_table_that_has_rows(spark):
    source, root = scratch_path(spark, "src"), scratch_path(spark, "grown")
    rows(spark, range(30), None).write.parquet(source)
    run(spark, source, root)
    later = scratch_path(spark, "src")
    rows(spark, range(20, 50), None).write.parquet(later)
    IN.run_to_completion(lambda: IN.start_ingest(stream_of(spark, later), f"{root}/t", f"{root}/s", f"{root}/ck2", by=["entity_id"]))
    columns = ["entity_id", "year_month", "total_income", "total_expense", "net", "transaction_count"]
    want = sorted(tuple(r) for r in S.monthly_summary(rows(spark, range(50), None), by=["entity_id"]).select(*columns).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/s").select(*columns).collect()) == want

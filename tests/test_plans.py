"""Plan shapes that carry the scale properties, checked on every registered query."""

import pytest

import __spark_entry__ as E
from ledgerlake.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
SKIP = {"stream_append_dedup", "stream_monthly_summary", "stream_ingest_summary", "append_batches", "etl_summary", "extract_log"}  # they run a stream or a job when called


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(fn(spark, SF)) for n, fn in REGISTRY.items() if n not in SKIP}


def test_no_cartesian_no_nested_loop_no_python(plans):
    for name, p in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                    "FlatMapGroupsInPandas", "MapInPandas"):
            assert bad not in p, (name, bad)


def test_per_entity_top_n_limits_before_the_shuffle(plans):
    for name in ("top_categories_by_entity", "latest_per_key"):
        p = plans[name]
        if name == "top_categories_by_entity":
            assert p.count("WindowGroupLimit") >= 2, name   # partial (map side) + final


def test_health_score_has_no_join(plans):
    assert "Join" not in plans["health_score_by_entity"]
    assert "Expand" in plans["health_score_by_entity"]


def formatted(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_month_filters_reach_the_scan(spark):
    p = formatted(E.queries()["monthly_summary_filtered"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p
    assert "In(o_orderstatus" in p


def test_scans_read_only_needed_columns(spark):
    p = formatted(E.queries()["monthly_summary"](spark, SF))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


def test_append_reads_only_keys(spark):
    from pyspark.sql import functions as F

    from ledgerlake.session import scratch_path
    from ledgerlake.sources import store as ST

    root = scratch_path(spark, "keys")
    base = spark.range(0, 2000).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("transaction_id"),
                                       F.format_string("2025-%02d", (F.col("id") % 12 + 1).cast("int")).alias("year_month"))
    base.write.partitionBy("year_month").parquet(root)
    existing = spark.read.parquet(root)
    incoming = spark.createDataFrame([("id5", "2025-01"), ("new", "2025-06")], "transaction_id string, year_month string")
    out = ST.append_new(existing, incoming)
    assert sorted(r.transaction_id for r in out.collect()) == ["new"]   # wherever id5 is held
    assert "ReadSchema: struct<transaction_id:string>" in formatted(out)


def test_context_reads_the_ledger_once(spark):
    """The pre-aggregate is written when the package is asked for; its sections read that table alone."""
    plan = REGISTRY["context_package"](spark, SF)
    scans = [line for line in plan_of(plan).splitlines() if "FileScan parquet" in line]
    assert scans and not [line for line in scans if "o_orderdate" in line or "orders.parquet" in line]

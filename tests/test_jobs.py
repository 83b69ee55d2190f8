"""ETL job, profiling report, DDL, SQL access and formatting helpers."""

import json

from pyspark.sql import functions as F

from ledgerlake.functions.exprs import format_money, format_pct, round_dec
from ledgerlake.operators import fire as FI
from ledgerlake.operators.classify import DEFAULT_CATEGORY_MAPPING
from ledgerlake.operators.clean import clean_transactions
from ledgerlake.plans import etl, profiling
from ledgerlake.schema import TABLES
from ledgerlake.session import scratch_path
from ledgerlake.sources import store as ST
from ledgerlake.sources.raw_csv import extract_transactions
from test_clean_ids import DIRTY, write_csv


def test_run_etl(spark):
    root = scratch_path(spark, "etl")
    calls = []

    def ok_sink(tx, summary):
        calls.append(summary.count())

    def bad_sink(tx, summary):
        raise ConnectionError("warehouse unreachable")

    res = etl.run_etl(spark, write_csv(DIRTY), root, mapping=DEFAULT_CATEGORY_MAPPING,
                      sinks={"docs": ok_sink, "warehouse": bad_sink})
    assert (res["rows_in"], res["rows_out"], res["bad_date"], res["bad_amount"]) == (11, 8, 2, 1)
    assert res["months"] == 1 and calls == [1]
    assert len(res["errors"]) == 1 and res["errors"][0].startswith("warehouse")
    tx = spark.read.parquet(res["transactions_path"])
    assert tx.count() == 8 and "year_month" in tx.columns
    # a second run upserts the same month: still one row, updated
    res2 = etl.run_etl(spark, write_csv(DIRTY), root, mapping=DEFAULT_CATEGORY_MAPPING)
    summ = ST.read_current(spark, f"{root}/monthly_summary")
    assert summ.count() == 1 and res2["months"] == 1


def test_profile_report_document(spark):
    raw = extract_transactions(spark, write_csv(DIRTY))
    clean = clean_transactions(raw, mapping=DEFAULT_CATEGORY_MAPPING)
    rep = json.loads(profiling.profile_report(raw, clean).collect()[0].report_json)
    assert rep["source_rows"] == 11 and rep["clean_rows"] == 8 and rep["rows_dropped_in_transform"] == 3
    assert rep["structural"]["duplicate_rows"] == 2 and rep["structural"]["column_count"] == 6
    cols = {c["column_name"]: c for c in rep["structural"]["columns"]}
    assert cols["tags"]["null_count"] == 1 and cols["category"]["top_values"][0] == {"value": "Food", "count": 5}  # raw text: "  Food " is another value
    st = rep["statistical"]
    assert sum(t["total_amount"] for t in st["type_totals"]) == sum(c["total_amount"] for c in st["category_breakdown"])
    assert st["date_range"]["row_count"] == 8
    path = profiling.write_report(profiling.profile_report(raw, clean), scratch_path(spark, "reports"))
    assert json.loads(spark.read.text(path).collect()[0].value)["clean_rows"] == 8


def test_ddl_and_sql_access(spark):
    created = ST.create_tables(spark, TABLES, scratch_path(spark, "ddl"))
    assert set(created) == set(TABLES)
    assert spark.table("transactions").schema.fieldNames()[0] == "transaction_id"
    df = spark.createDataFrame([("2025-01", "Food", 2.5), ("2025-02", "Food", 1.0)], "year_month string, category string, amount double")
    ST.register(df, "tx_view")
    out = ST.run_query(spark, "SELECT SUM(amount) AS s FROM tx_view WHERE year_month >= ?", ["2025-02"]).collect()
    assert out[0].s == 1.0
    named = ST.run_query(spark, "SELECT COUNT(*) AS n FROM tx_view WHERE category = :c", {"c": "Food"}).collect()
    assert named[0].n == 2


def test_formatting_and_rounding(spark):
    df = spark.createDataFrame([(1234.567, 1.005), (None, -2.5)], "v double, p double")
    rows = df.select(format_money("v").alias("m"), format_pct("p").alias("p"), round_dec("p", 2).alias("r")).collect()
    # ties round away from zero on the decimal value, as everywhere in the library
    # (Python's f"{1.005:+.2f}" gives +1.00 from the binary value just below the tie)
    assert rows[0].m == "1,234.57 BYN" and rows[0].p == "+1.01%"
    assert rows[1].m == "—" and rows[1].p == "-2.50%" and rows[1].r == -2.5
    assert rows[0].r == 1.01  # half away from zero on the decimal value


def test_compounding_options(spark):
    df = spark.createDataFrame([(12.0, 3.0)], "r double, i double")
    row = df.select(FI.monthly_return("r", "nominal").alias("n"), FI.monthly_return("r").alias("e"),
                    FI.real_return_pct("r", "i").alias("real")).collect()[0]
    assert row.n == 0.01 and abs(row.e - (1.12 ** (1 / 12) - 1)) < 1e-15
    assert abs(row.real - (1.12 / 1.03 - 1) * 100) < 1e-12
    key = df.select(ST.cache_key(F.lit("{}"), F.lit("why?")).alias("k")).collect()[0].k
    assert len(key) == 64


def test_scale_conf_and_touched_partitions(spark):
    from ledgerlake.session import scale_conf

    conf = scale_conf(100 * 2**40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409601
    assert scale_conf(10, cores=8)["spark.sql.shuffle.partitions"] == "8"
    table = spark.createDataFrame([(f"k{i}", f"2025-{1 + i % 12:02d}") for i in range(120)], "k string, year_month string")
    changes = spark.createDataFrame([("x", "2025-03"), ("y", "2025-04")], "k string, year_month string")
    static = ST.restrict_to_touched(table, changes, ["year_month"])
    assert static.count() == 20


def test_profile_report_cleans_once(spark):
    """Its sections read the cleaned rows that were written, not the cleaner's plan again."""
    raw = spark.range(20).selectExpr("'2025-01-01' date_time", "'Food' category", "'a' account", "cast(id as string) amount", "'BYN' currency", "'t' tags")
    for report in (profiling.profile_report, profiling.profiling_summary):
        plan = report(raw, clean_transactions(raw))._jdf.queryExecution().optimizedPlan().toString()
        assert "_content" not in plan and "sequence(" not in plan

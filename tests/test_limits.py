"""Sizes and values that earlier versions dropped, capped or overflowed on."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import anomaly as AN
from ledgerlake.operators import clean as CN
from ledgerlake.operators import fire as FI
from ledgerlake.operators import health as HE
from ledgerlake.operators import profile as PR
from ledgerlake.operators import scenario as SC
from ledgerlake.plans import marts as MT
from ledgerlake.sources.raw_csv import extract_transactions

from conftest import tx

RAW = "date_time string, category string, account string, amount string, currency string, tags string"


def raw(spark, *rows):
    return spark.createDataFrame([(d, c, "a", v, "BYN", "t") for d, c, v in rows], RAW)


def test_projection_beyond_2048_months(spark):
    inputs = spark.createDataFrame([(1000.0, 900.0, 0.0, 3.0, 4.0, 30, 280)],
                                   "monthly_income double, monthly_expense double, current_savings double, "
                                   "annual_return_pct double, withdrawal_rate_pct double, current_age int, target_age int")
    rows = {r.month: r.portfolio_value for r in FI.fire_projection(inputs).collect()}
    assert len(rows) == 3001 and None not in rows.values()
    r = 1.03 ** (1 / 12) - 1
    assert rows[3000] == pytest.approx(100 * ((1 + r) ** 3000 - 1) / r, rel=1e-9)
    assert FI.fire_projection(inputs.withColumn("target_age", F.lit(20))).count() == 0


def test_many_scenarios_from_a_table(spark, make_ledger):
    led = make_ledger([tx("2025-01-01", "Food", "Expense", "a", 10), tx("2025-01-02", "Job", "Income", "a", 30)])
    table = spark.range(1001).select(F.concat(F.lit("s"), "id").alias("name"), F.lit("increase_income").alias("kind"),
                                     F.col("id").cast("double").alias("pct"))
    out = SC.scenario_results(led, table)
    assert out.count() == 1001
    assert out.where("scenario = 's100'").first().adjusted_monthly_income == 60.0


def test_large_mapping_as_dict_and_as_table(spark):
    mapping = {f"c{i}": "Income" if i % 2 else "Expense" for i in range(10_001)}
    rows = raw(spark, ("2025-01-01 00:00:00", "c9999", "1"), ("2025-01-01 00:00:00", "c10000", "1"), ("2025-01-01 00:00:00", "zz", "1"))
    want = {"c9999": "Income", "c10000": "Expense", "zz": "Expense"}
    assert {r.category: r.type for r in CN.clean_transactions(rows, mapping=mapping).collect()} == want
    table = spark.createDataFrame(list(mapping.items()), "category string, type string")
    assert {r.category: r.type for r in CN.clean_transactions(rows, mapping=table).collect()} == want


def test_amounts_are_kept_exactly_or_rejected(spark):
    rows = raw(spark, ("2025-01-01", "Food", "0.125"), ("2025-01-01", "Food", "20000000000000000"))
    assert CN.clean_transactions(rows).count() == 0
    assert {(r.amount, r.reason) for r in CN.rejected_transactions(rows).collect()} == {("0.125", "unfit_amount"), ("20000000000000000", "unfit_amount")}
    got = sorted(float(r.amount) for r in CN.clean_transactions(rows, amount_type="decimal(28,6)").collect())
    assert got == [0.125, 2e16]


def test_dates_and_text(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = raw(spark, ("2025-03-09 02:30", "\tFood ", "1"), ("2025/03/09 02:30:15", "a", "1"), ("2025-03-09T02:30:15.25Z", "b", "1"),
                   ("2025-03-09", "c", "1"), ("not-a-date", "d", "1"), ("12:30", "e", "1"), ("2025-13-01", "f", "1"))
        got = {r.category: str(r.t) for r in CN.clean_transactions(rows).select("category", F.col("transaction_datetime").cast("string").alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {"Food": "2025-03-09 02:30:00", "a": "2025-03-09 02:30:15", "b": "2025-03-09 02:30:15.25", "c": "2025-03-09 00:00:00"}


def test_large_amounts_do_not_overflow(make_ledger):
    big = "9000000000000000"
    led = make_ledger([tx(f"2025-{m:02d}-{d:02d}", "Food", "Expense", "a", int(big) + (m % 2)) for m in range(1, 13) for d in range(1, 29) for _ in range(4)])
    st = PR.amount_stats(led).first()
    assert st.median >= 9e15 and st.std_amount is not None
    assert HE.health_score(led).count() == 1
    assert AN.detect_anomalies(led).count() == 0


def test_empty_ledger_has_no_score(make_ledger):
    led = make_ledger([tx("2025-01-01", "Food", "Expense", "a", 1)]).where(F.lit(False))
    assert HE.health_score(led).count() == 0


def test_mart_does_not_double_count(make_ledger):
    led = make_ledger([tx("2025-01-01", "Food", "Expense", "a", 10), tx("2025-01-02", "Food", "Income", "a", 5)])
    assert {r.type: r.total_amount for r in MT.category_month_mart(led).collect()} == {"Expense": 10.0, "Income": 5.0}


def test_csv_quotes_lines_and_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date_time,category,account,amount,currency,tags\n2025-01-01,"say ""hi"", ok",a,1,BYN,t\n2025-01-02,"two\nlines",a,2,BYN,t\n')
    (tmp_path / "b.csv").write_text("date_time,account,category,amount,currency,tags,note\n2025-01-03,acct,Food,3,BYN,t,x\n")
    got = {r.amount: (r.category, r.account) for r in extract_transactions(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"1": ('say "hi", ok', "a"), "2": ("two\nlines", "a"), "3": ("Food", "acct")}

"""Raw log scan, cleaning rules (FIXTURES FX1) and the order-free stable id."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerlake.operators.classify import DEFAULT_CATEGORY_MAPPING
from ledgerlake.operators.clean import TransformError, clean_transactions, rejected_transactions
from ledgerlake.operators.stable_id import assign_stable_ids
from ledgerlake.sources.raw_csv import ExtractError, extract_transactions

HEADER = "date_time,category,account,amount,currency,tags"
DIRTY = [
    "not-a-date,Food,acct_1,5,BYN,tag_1",                 # bad date
    "2025-01-07 00:00:00,Food,acct_1,x,BYN,tag_1",         # bad amount
    "garbage,Food,acct_1,y,BYN,tag_1",                     # both bad: counted as bad date
    "2025-01-08 10:00:00,Food,acct_1,-12.5,BYN,tag_1",     # negative -> 12.50
    '2025-01-09 10:00:00,"  Food ",acct_1,3,BYN,tag_1',    # padded text
    "2025-01-10 10:00:00,Food,acct_1,3,BYN,",              # missing tag -> nan
    "2025-01-11 10:00:00,Pets,acct_1,3,BYN,tag_1",         # unmapped -> Expense
    "2025-01-12 10:00:00,Job,acct_1,30,BYN,tag_1",         # Income
    "2025-01-13 10:00:00,Cafe,acct_2,4.5,BYN,tag_2",       # exact repeat x3
    "2025-01-13 10:00:00,Cafe,acct_2,4.5,BYN,tag_2",
    "2025-01-13 10:00:00,Cafe,acct_2,4.5,BYN,tag_2",
]


def write_csv(lines, header=HEADER):
    d = tempfile.mkdtemp(prefix="ll-csv-")
    p = os.path.join(d, "tx.csv")
    with open(p, "w") as f:
        f.write(header + "\n" + "\n".join(lines) + ("\n" if lines else ""))
    return p


def test_dirty_rows(spark):
    raw = extract_transactions(spark, write_csv(DIRTY))
    obs = Observation("t")
    out = clean_transactions(raw, mapping=DEFAULT_CATEGORY_MAPPING, observation=obs)
    rows = out.collect()
    m = obs.get
    assert (m["rows_in"], m["bad_date"], m["bad_amount"], m["rows_out"]) == (11, 2, 1, 8)
    assert (m["income_rows"], m["expense_rows"]) == (1, 7)
    assert len(rows) == 8
    by_day = {r.transaction_date.isoformat(): r for r in rows}
    assert float(by_day["2025-01-08"].amount) == 12.5
    assert by_day["2025-01-09"].category == "Food"
    assert by_day["2025-01-10"].tags == "nan"
    assert by_day["2025-01-11"].type == "Expense"
    assert by_day["2025-01-12"].type == "Income"
    repeats = [r for r in rows if r.category == "Cafe"]
    assert len(repeats) == 3 and len({r.transaction_id for r in repeats}) == 3
    assert all(len(r.transaction_id) == 24 for r in rows)
    assert out.columns[:3] == ["transaction_id", "transaction_date", "transaction_datetime"]
    # the id is sha256 over the cleaned text and the occurrence number
    r = by_day["2025-01-12"]
    want = hashlib.sha256("2025-01-12 10:00:00|Job|acct_1|30.0|tag_1|0".encode()).hexdigest()[:24]
    assert r.transaction_id == want


def test_ids_do_not_depend_on_order_or_partitioning(spark):
    raw = extract_transactions(spark, write_csv(DIRTY))
    a = {r.transaction_id for r in clean_transactions(raw).collect()}
    shuffled = raw.orderBy(F.rand(7)).repartition(5)
    b = {r.transaction_id for r in clean_transactions(shuffled).collect()}
    rev = extract_transactions(spark, write_csv(list(reversed(DIRTY))))
    c = {r.transaction_id for r in clean_transactions(rev).collect()}
    assert a == b == c


def test_hot_group_chunking_matches_plain_numbering(spark):
    # 2,500 copies of one row plus a few others; chunk of 100 forces the hot path
    rows = [("2025-01-01 00:00:00", "Food", "a", "1.0", "BYN", "t")] * 2500
    rows += [("2025-01-02 00:00:00", "Food", "a", "1.0", "BYN", "t")] * 3
    rows += [("2025-01-01 00:00:00", "Food", "a", "1.0", "USD", "t")] * 2   # same text, other currency
    df = spark.createDataFrame(rows, "date_time string, category string, account string, amount string, currency string, tags string")
    hot = assign_stable_ids(df, ["date_time", "category", "account", "amount", "tags"], ["currency"], chunk_rows=100).collect()
    plain = assign_stable_ids(df, ["date_time", "category", "account", "amount", "tags"], ["currency"], chunk_rows=10**9).collect()
    assert len(hot) == len(plain) == 2505
    assert sorted((r.transaction_id, r.currency) for r in hot) == sorted((r.transaction_id, r.currency) for r in plain)
    assert len({r.transaction_id for r in hot}) == 2505
    expected = {hashlib.sha256(f"2025-01-01 00:00:00|Food|a|1.0|t|{i}".encode()).hexdigest()[:24] for i in range(2502)}
    assert {r.transaction_id for r in hot if r.date_time.startswith("2025-01-01")} == expected


def test_extract_errors(spark):
    with pytest.raises(ExtractError, match="tags"):
        extract_transactions(spark, write_csv(["2025-01-01 00:00:00,Food,a,1,BYN"], header="date_time,category,account,amount,currency"))
    with pytest.raises(ExtractError):
        extract_transactions(spark, "/nonexistent/path/tx.csv")
    extra = extract_transactions(spark, write_csv(["2025-01-01 00:00:00,Food,a,1,BYN,t,hello"], header=HEADER + ",note"))
    out = clean_transactions(extra).collect()
    assert len(out) == 1 and "note" not in out[0].asDict()
    empty = extract_transactions(spark, write_csv([]))
    with pytest.raises(TransformError):
        clean_transactions(empty, require_non_empty=True)


def test_hot_third_is_spread_across_tasks(spark):
    """A third of all rows are copies of one row: ids stay exact and the copies are generated by many tasks."""
    n, hot = 90_000, 30_000
    base = spark.range(0, n).select(
        F.when(F.col("id") < hot, F.lit("2025-01-01 00:00:00"))
        .otherwise(F.format_string("2025-01-%02d %05d", (F.col("id") % 28 + 1).cast("int"), F.col("id").cast("int")))
        .alias("date_time"),
        F.lit("Food").alias("category"), F.lit("a").alias("account"), F.lit("1.0").alias("amount"), F.lit("t").alias("tags"),
    )
    out = assign_stable_ids(base, ["date_time", "category", "account", "amount", "tags"], chunk_rows=2_000)
    hot_rows = out.where(F.col("date_time") == "2025-01-01 00:00:00")
    per_task = [r["count"] for r in hot_rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == hot and len(per_task) >= 4 and max(per_task) < hot / 2
    assert out.count() == n and out.select("transaction_id").distinct().count() == n


def test_option_paths(spark):
    from ledgerlake.operators import macro as MA

    raw = extract_transactions(spark, write_csv(DIRTY))
    keep_null = clean_transactions(raw, missing_text=None, drop_duplicate_ids=True).collect()
    assert len(keep_null) == 8 and len({r.transaction_id for r in keep_null}) == 8
    assert [r.tags for r in keep_null if r.transaction_date.isoformat() == "2025-01-10"] == [None]
    obs = spark.createDataFrame([("S", f"2025-{m:02d}-01", str(100 + m)) for m in range(1, 13)] + [("S", "2024-12-01", "100")],
                                "series_id string, date string, value string")
    r = MA.macro_indicators(obs, yoy_series=None, labels={}).collect()[0]
    assert r.label is None and r.n_usable == 13 and r.yoy_change_pct == 12.0


def test_reasons_are_worked_out_once(spark):
    """A filter on the reason would repeat it below the projection, parses and failing casts included."""
    raw = spark.range(10).selectExpr("if(id < 2, 'no', '2025-01-0' || id) date_time", "case id when 5 then 'x' when 6 then 'inf' when 7 then 'nan' else '1' end amount")
    bad = rejected_transactions(raw)
    assert "Filter" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["amount"], r["reason"]) for r in bad.collect()) == [
        ("1", "bad_date"), ("1", "bad_date"), ("inf", "unfit_amount"), ("nan", "bad_amount"), ("x", "bad_amount")]

"""Every raw row is either kept exactly or rejected with a reason, and counted."""

import random

import pytest
from pyspark.sql import Observation

from ledgerlake.operators import clean as CN
from ledgerlake.plans import etl
from ledgerlake.session import scratch_path

RAW = "date_time string, category string, account string, amount string, currency string, tags string"
DATES = ["2025-01-07 10:00:00", "2025-13-01", "", None, "2025/02/03"]
AMOUNTS = ["1", "-2.50", "0.125", "inf", "-inf", "nan", "NaN", "", None, "x", "1e3", "1e16", "9999999999999999.99", "1e300", " 4.4 ", "0.1", "1e-9", "12,5"]


def expected(date, amount, places=2, digits=18):
    from decimal import Decimal

    if date in ("2025-13-01", "", None):
        return CN.BAD_DATE
    try:
        v = float((amount or "").strip())
    except ValueError:
        return CN.BAD_AMOUNT
    if v != v:
        return CN.BAD_AMOUNT
    if v in (float("inf"), float("-inf")):
        return CN.UNFIT_AMOUNT
    if abs(v) >= 1e24:
        return CN.UNFIT_AMOUNT
    near = round(Decimal(v), places)
    return None if float(near) == v and abs(near) < 10 ** (digits - places) else CN.UNFIT_AMOUNT


def all_rows():
    return [(d, "c", "a", v, "BYN", "t") for d in DATES for v in AMOUNTS] * 2


@pytest.mark.parametrize("kind,places,digits", [("decimal(18,2)", 2, 18), ("decimal(28,6)", 6, 28)])
def test_reasons(spark, kind, places, digits):
    raw = spark.createDataFrame(all_rows(), RAW)
    got = sorted((str(r.date_time), str(r.amount), r.reason) for r in CN.rejected_transactions(raw, amount_type=kind).collect())
    want = [(str(r[0]), str(r[3]), expected(r[0], r[3], places, digits)) for r in all_rows()]
    assert got == sorted(w for w in want if w[2])
    kept = CN.clean_transactions(raw, amount_type=kind)
    assert kept.count() + len(got) == len(want)


def test_counts_add_up(spark):
    raw, obs = spark.createDataFrame(random.Random(1).sample(all_rows(), 150), RAW), Observation()
    n = CN.clean_transactions(raw, observation=obs).count()
    m = obs.get
    assert m["rows_in"] == 150 == m["rows_out"] + m["bad_date"] + m["bad_amount"] + m["unfit_amount"] and m["rows_out"] == n
    assert min(m["bad_date"], m["bad_amount"], m["unfit_amount"]) > 0


def test_the_job_keeps_rejected_rows(spark):
    raw, root = spark.createDataFrame(all_rows(), RAW), scratch_path(spark, "etl-rejects")
    res = etl.run_etl(spark, "", root, raw=raw)
    assert res["rejected"] + res["rows_out"] == res["rows_in"] == len(all_rows()) and not res["errors"]
    assert spark.read.parquet(res["rejected_path"]).count() == res["rejected"]
    assert spark.read.parquet(res["transactions_path"]).count() == res["rows_out"]

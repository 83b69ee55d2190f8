"""Health score against a direct transcription of the formulas; budget status cases (FX5)."""

import random
from decimal import Decimal

import numpy as np
import pytest
from conftest import tx
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.stats import from_halves, halves, has_halves
from ledgerlake.operators import budget as BU
from ledgerlake.operators import health as HE
from ledgerlake.operators import summary as S

W = [0.40, 0.25, 0.15, 0.20]


def expected(monthly, cats, snapshot):
    inc = sum(m["total_income"] for m in monthly)
    net = sum(m["net"] for m in monthly)
    rate = net / inc * 100 if inc > 0 else 0.0
    subs = [float(np.clip(rate / 50 * 100, 0, 100))]
    for k in ("total_expense", "total_income"):
        v = np.array([m[k] for m in monthly])
        std = v.std(ddof=0) if len(v) > 1 else 0.0
        cv = std / v.mean() if v.mean() else 0.0
        subs.append(float(np.clip(100 - cv * 100, 0, 100)))
    t = np.array([c["total_amount"] for c in cats if c["type"] == "Expense"])
    if len(t) and t.sum() > 0:
        hhi = float(((t / t.sum()) ** 2).sum())
        subs.append(float(np.clip((1 - hhi) * 100, 0, 100)))
    else:
        hhi = None
        subs.append(0.0)
    if snapshot:
        subs = [round(s, 1) for s in subs]
    comp = sum(s * w for s, w in zip(subs, W))
    return subs, comp, hhi


def test_health_matches_formulas(make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Job", "Income", "a", 1000), tx("2025-01-06", "Food", "Expense", "a", 300),
        tx("2025-02-05", "Job", "Income", "a", 1200), tx("2025-02-06", "Cafe", "Expense", "a", 500),
        tx("2025-03-05", "Job", "Income", "a", 900), tx("2025-03-06", "Food", "Expense", "a", 100),
        tx("2025-03-07", "Taxi", "Expense", "a", 50),
    ])
    monthly = [r.asDict() for r in S.monthly_summary(led).collect()]
    cats = [r.asDict() for r in S.category_breakdown(led).collect()]
    for snap in (False, True):
        subs, comp, hhi = expected(monthly, cats, snap)
        r = HE.health_score(led, snapshot=snap).collect()[0]
        got = [r.savings_score, r.expense_stability_score, r.income_stability_score, r.diversification_score]
        assert np.allclose(got, subs, rtol=0, atol=1e-9)
        assert abs(r.composite_score - (round(comp, 1) if snap else comp)) < 1e-9
        assert r.band == ("Healthy" if comp >= 75 else "Fair" if comp >= 50 else "At Risk")
        assert r.category_hhi == round(hhi, 3)


def test_health_edges(make_ledger):
    one_month_no_expense = make_ledger([tx("2025-01-05", "Job", "Income", "a", 100)])
    r = HE.health_score(one_month_no_expense).collect()[0]
    assert r.expense_stability_score == 100.0 and r.income_stability_score == 100.0
    assert r.diversification_score == 0.0 and r.category_hhi is None
    assert r.savings_score == 100.0
    no_income = make_ledger([tx("2025-01-05", "Food", "Expense", "a", 100)])
    r2 = HE.health_score(no_income).collect()[0]
    assert r2.savings_score == 0.0 and r2.overall_savings_rate_pct == 0.0


def test_health_inputs_count_nulls_and_other_types_as_before(spark):
    rows = [(1, "2025-01", "Job", "Income", "10.01"), (1, "2025-01", None, "Expense", "3.00"), (1, "2025-01", "Move", "Transfer", "5.00"),
            (1, "2025-02", "Job", "Income", None), (1, "2025-03", "Food", "Expense", None), (1, "2025-03", "Food", None, "-7.50"),
            (1, None, "Food", "Expense", "2.25"), (None, "2025-01", "Job", "Income", "1.00"), (None, "2025-01", "Food", "Income", "4.00")]
    led = spark.createDataFrame([(e, m, c, t, a and Decimal(a)) for e, m, c, t, a in rows],
                                "entity_id long, year_month string, category string, type string, amount decimal(18,2)")
    names = ["s_inc", "s_exp", "s_net", "n_months", "s2_inc", "s2_exp", "t1", "t2", "n_exp_cats"]
    want = {1: ("10.01", "5.25", "7.26", 4, "100.2001", "14.0625", "5.25", "14.0625", 2), None: ("5.00", "0.00", "5.00", 1, "25.0000", "0.0000", None, None, 0)}
    for ledger in (led, led.withColumn("amount", F.col("amount").cast("decimal(28,2)"))):   # longs, decimals
        got = {r.entity_id: tuple(None if r[n] is None else r[n] if isinstance(r[n], int) else str(r[n]) for n in names)
               for r in HE.health_inputs(ledger, by=["entity_id"]).collect()}
        assert got == want


@pytest.mark.parametrize("precision, scale", [(18, 2), (18, 6), (9, 0)])
def test_halves_sum_exactly(spark, precision, scale):
    r = random.Random(1)
    top = 10**precision - 1
    units = [top, -top, top, top, -1, 0, 1, -(1 << 30), (1 << 30) - 1] + [r.randint(-top, top) for _ in range(200)]
    units = [u for u in units if abs(u) <= top]
    kind = T.DecimalType(precision, scale)
    assert has_halves(kind) and not has_halves(T.DecimalType(19, 2)) and not has_halves(T.DoubleType())
    df = spark.createDataFrame([(Decimal(u).scaleb(-scale),) for u in units] + [(None,)], T.StructType([T.StructField("c", kind)]))
    hi, lo = halves("c", kind)
    sums = df.agg(F.sum("c").alias("want"), F.sum(hi).alias("h"), F.sum(lo).alias("l")).select("want", from_halves("h", "l", kind).alias("got"))
    assert sums.schema["got"].dataType == sums.schema["want"].dataType
    row = sums.first()
    assert row.got == row.want == Decimal(sum(units)).scaleb(-scale)


def test_ledger_rows_are_dealt_by_entity_before_they_are_grouped(make_ledger):
    led = make_ledger([tx("2025-01-05", "Job", "Income", "a", 100)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(HE.health_score(led, by=["entity_id"]))
    assert "REBALANCE" not in plan(HE.health_score(led))   # one ledger: a row per month and task leaves the scan
    assert "REBALANCE" not in plan(HE.health_score(S.preaggregate(led, by=["entity_id"]), by=["entity_id"]))


def test_budget_cases(spark, make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Food", "Expense", "a", 300),
        tx("2025-01-06", "Taxi", "Expense", "a", 80),     # spend without plan -> absent
        tx("2025-01-07", "Job", "Income", "a", 999),
    ])
    plans = spark.createDataFrame([("p1", "Food", 100.0), ("p2", "Food", 250.0), ("p3", "Gifts", 40.0)],
                                  "budget_id string, category string, monthly_limit double")
    st = {r.category: r for r in BU.budget_status(led, plans).collect()}
    assert set(st) == {"Food", "Gifts"}
    assert st["Food"].monthly_limit == 250.0 and st["Food"].actual == 300.0 and st["Food"].over_under == 50.0
    assert st["Food"].is_over and st["Food"].over_rank == 1
    assert st["Gifts"].actual == 0.0 and st["Gifts"].over_under == -40.0 and st["Gifts"].over_rank is None
    tot = BU.over_budget_total(led, plans).collect()[0]
    assert (tot.total_over_budget_amount, tot.n_over_budget, tot.n_planned) == (50.0, 1, 2)
    empty_plans = spark.createDataFrame([], "budget_id string, category string, monthly_limit double")
    assert BU.budget_status(led, empty_plans).collect() == []

"""For every per-entity operator: the answer for one entity equals the single-ledger answer on its rows alone."""

import pytest
from conftest import tx
from pyspark.sql import functions as F

from ledgerlake.operators import anomaly as AN
from ledgerlake.operators import budget as BU
from ledgerlake.operators import fire as FI
from ledgerlake.operators import health as HE
from ledgerlake.operators import profile as PR
from ledgerlake.operators import scenario as SC
from ledgerlake.operators import summary as S
from ledgerlake.operators import trends as TR

BY = ["entity_id"]


@pytest.fixture(scope="module")
def ledger(make_ledger):
    rows = []
    for e, scale in ((1, 1), (2, 3), (3, 7)):
        for m in range(1, 13):
            rows.append(tx(f"2024-{m:02d}-05", "Job", "Income", "a1", 1000 * scale + m, entity=e))
            rows.append(tx(f"2024-{m:02d}-06", "Food", "Expense", "a1", 100 * scale + 7 * m, entity=e))
            if m % 3 == 0:
                rows.append(tx(f"2024-{m:02d}-07", "Shop", "Expense", "a2", 900 * scale if m == 9 else 50, entity=e))
    return make_ledger(rows)


def rows(df, drop=()):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


CASES = {
    "monthly_summary": lambda led, by: S.monthly_summary(led, by=by),
    "category_breakdown": lambda led, by: S.category_breakdown(led, by=by),
    "top_categories": lambda led, by: S.top_categories(led, 1, "Expense", by=by),
    "account_breakdown": lambda led, by: S.account_breakdown(led, by=by),
    "kpi_totals": lambda led, by: S.kpi_totals(led, by=by),
    "trends": lambda led, by: TR.monthly_trends(led, by=by, rolling=(3, 6), running=True),
    "anomalies": lambda led, by: AN.detect_anomalies(led, 1.5, by=by),
    "health_display": lambda led, by: HE.health_score(led, by=by),
    "health_snapshot": lambda led, by: HE.health_score(led, by=by, snapshot=True),
    "whatif": lambda led, by: SC.scenario_results(
        led, SC.DEFAULT_SCENARIOS + (SC.Scenario("Cut shop", "reduce_category", pct=50, keywords=("shop",)),), by=by),
    "fire": lambda led, by: FI.fire_plan(FI.planner_inputs(led, by=by), by=by),
    "amount_stats": lambda led, by: PR.amount_stats(led, by=by),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_per_entity_equals_single_ledger(ledger, name):
    fn = CASES[name]
    per = fn(ledger, BY)
    for e in (1, 2, 3):
        alone = fn(ledger.where(F.col("entity_id") == e), [])
        assert rows(per.where(F.col("entity_id") == e), drop=BY) == rows(alone), (name, e)


def test_budget_per_entity(spark, ledger):
    plans = spark.createDataFrame([(e, f"p{e}", "Food", 150.0 * e) for e in (1, 2, 3)] + [(2, "x", "Shop", 10.0)],
                                  "entity_id long, budget_id string, category string, monthly_limit double")
    per = BU.budget_status(ledger, plans, by=BY)
    for e in (1, 2, 3):
        alone = BU.budget_status(ledger.where(F.col("entity_id") == e), plans.where(F.col("entity_id") == e).drop("entity_id"))
        assert rows(per.where(F.col("entity_id") == e), drop=BY) == rows(alone)

"""Aggregates, trends and anomalies on hand-made ledgers with hand-computed answers."""

from conftest import tx

from ledgerlake.functions.filters import LedgerFilter
from ledgerlake.operators import anomaly as AN
from ledgerlake.operators import summary as S
from ledgerlake.operators import trends as TR


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_monthly_summary_edges(make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Job", "Income", "a1", 100),
        tx("2025-01-06", "Food", "Expense", "a1", 30),
        tx("2025-02-01", "Food", "Expense", "a1", 10),   # month without income -> savings rate null
        tx("2025-04-01", "Job", "Income", "a2", 50),     # March skipped
        tx("2025-04-02", "Pets", "Other", "a2", 5),      # a type that is neither: subtracts in net only
    ])
    m = rows_by(S.monthly_summary(led), "year_month")
    assert set(m) == {"2025-01", "2025-02", "2025-04"}
    assert m["2025-01"]["net"] == 70.0 and m["2025-01"]["savings_rate_pct"] == 70.0
    assert m["2025-02"]["savings_rate_pct"] is None
    assert m["2025-04"]["total_expense"] == 0.0 and m["2025-04"]["net"] == 45.0
    assert m["2025-04"]["transaction_count"] == 2


def test_filters_and_top_categories(make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Food", "Expense", "a1", 10),
        tx("2025-01-06", "Cafe", "Expense", "a1", 10),   # tie with Food: category name breaks it
        tx("2025-02-06", "Taxi", "Expense", "a2", 5),
        tx("2025-02-07", "Job", "Income", "a2", 500),
    ])
    top = S.top_categories(led, n=1, type_filter="Expense").collect()
    assert [r.category for r in top] == ["Cafe"]
    # the type argument replaces the filter's own type list
    f = LedgerFilter(start_ym="2025-02", types=("Expense",))
    top_inc = S.top_categories(led, n=5, type_filter="Income", filters=f).collect()
    assert [(r.category, r.total_amount) for r in top_inc] == [("Job", 500.0)]
    acc = rows_by(S.account_breakdown(led, {"accounts": ["a2"]}), "account")
    assert acc == {"a2": {"account": "a2", "total_expense": 5.0, "total_income": 500.0, "transaction_count": 2}}
    empty = S.monthly_summary(led, {"start_ym": "2026-01"}).collect()
    assert empty == []


def test_trends_gap_month_and_zero_previous(make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Food", "Expense", "a1", 0),
        tx("2025-01-05", "Job", "Income", "a1", 100),
        tx("2025-02-05", "Food", "Expense", "a1", 40),
        tx("2025-04-05", "Food", "Expense", "a1", 60),   # previous present month is February
    ])
    t = rows_by(TR.monthly_trends(led, rolling=(3,), running=True), "year_month")
    assert t["2025-01"]["expense_mom_change_pct"] is None
    assert t["2025-02"]["expense_mom_change_pct"] is None       # previous expense 0
    assert t["2025-04"]["expense_mom_change_pct"] == 50.0       # 40 -> 60, March skipped
    assert t["2025-02"]["income_mom_change_pct"] == -100.0
    assert t["2025-04"]["expense_3mo_avg"] == round((0 + 40 + 60) / 3, 2)
    assert t["2025-04"]["running_net"] == 100.0 - 100.0
    # the filter applies before the window: the first month shown has no change
    tf = rows_by(TR.monthly_trends(led, {"start_ym": "2025-04"}), "year_month")
    assert tf["2025-04"]["expense_mom_change_pct"] is None


def test_anomalies(make_ledger):
    rows = [tx(f"2025-{m:02d}-01", "Food", "Expense", "a", 10) for m in range(1, 10)]
    rows += [tx("2025-10-01", "Food", "Expense", "a", 100)]
    rows += [tx("2025-01-01", "Once", "Expense", "a", 999)]                       # one month: std null
    rows += [tx(f"2025-0{m}-01", "Flat", "Expense", "a", 5) for m in range(1, 4)]  # std 0
    led = make_ledger(rows)
    out = AN.detect_anomalies(led, 2.0).collect()
    assert [(r.category, r.year_month) for r in out] == [("Food", "2025-10")]
    r = out[0]
    vals = [10] * 9 + [100]
    import statistics
    assert r.category_mean == round(statistics.mean(vals), 2)
    assert r.category_std == round(statistics.stdev(vals), 2)
    assert abs(r.z_score - round((100 - statistics.mean(vals)) / statistics.stdev(vals), 2)) < 1e-9


def test_per_entity_matches_single_entity(make_ledger):
    a = [tx("2025-01-05", "Food", "Expense", "a1", 10, entity=1), tx("2025-02-05", "Job", "Income", "a1", 20, entity=1)]
    b = [tx("2025-01-07", "Food", "Expense", "a1", 7, entity=2)]
    led = make_ledger(a + b)
    per = {(r.entity_id, r.year_month): r.net for r in S.monthly_summary(led, by=["entity_id"]).collect()}
    only1 = {r.year_month: r.net for r in S.monthly_summary(led.where("entity_id = 1")).collect()}
    assert {k[1]: v for k, v in per.items() if k[0] == 1} == only1
    assert per[(2, "2025-01")] == -7.0


def test_kpis_and_filter_values(make_ledger):
    led = make_ledger([tx("2025-01-05", "Food", "Expense", "a1", 30), tx("2025-03-05", "Job", "Income", "a2", 120)])
    k = S.kpi_totals(led).collect()[0]
    assert (k.total_income, k.total_expense, k.net, k.savings_rate_pct, k.transaction_count, k.months_covered) == (
        120.0, 30.0, 90.0, 75.0, 2, 2)
    fv = {(r.field, r.value) for r in S.filter_values(led).collect()}
    assert fv == {("year_month", "2025-01"), ("year_month", "2025-03"), ("account", "a1"), ("account", "a2"),
                  ("category", "Food"), ("category", "Job")}

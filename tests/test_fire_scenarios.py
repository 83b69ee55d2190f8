"""FIRE closed form against the planner's month-by-month loop; what-if scenario cases (FX8, FX9)."""

import itertools

from conftest import tx
from pyspark.sql import functions as F

from ledgerlake.operators import fire as FI
from ledgerlake.operators import scenario as SC


def loop_fire_month(expense, income, savings, annual_pct, age, target, number):
    """The planner's loop, returning the month index (not the age)."""
    c = max(income - expense, 0.0)
    r = (1 + annual_pct / 100.0) ** (1 / 12) - 1
    bal = savings
    for m in range((target - age) * 12 + 1):
        if number > 0 and bal >= number:
            return m
        bal = bal * (1 + r) + c
    return None


def test_first_month_matches_loop(spark):
    combos = list(itertools.product(
        [0.0, 800.0, 2500.0],          # monthly expense
        [0.0, 1000.0, 4000.0],         # monthly income
        [0.0, 50000.0, 900000.0],      # current savings
        [0.0, 1.0, 7.0, 15.0],         # annual return
        [(30, 50), (40, 41), (16, 100)],
    ))
    rows = [(i, e, inc, s, r, a, t) for i, (e, inc, s, r, (a, t)) in enumerate(combos)]
    df = spark.createDataFrame(rows, "i int, monthly_expense double, monthly_income double, current_savings double, "
                                     "annual_return_pct double, current_age int, target_age int")
    df = df.withColumn("withdrawal_rate_pct", F.lit(4.0))
    got = {r.i: r.fire_month for r in FI.fire_plan(df, by=["i"]).collect()}
    for i, e, inc, s, r, a, t in rows:
        assert got[i] == loop_fire_month(e, inc, s, r, a, t, e * 12 * 25), (e, inc, s, r, a, t)


def test_fire_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, 1000.0, 1000.0, 0.0, 7.0, 30, 50),     # expense == income: contribution 0, never
         (2, 1000.0, 3000.0, 0.0, 0.0, 30, 50),     # return 0: linear
         (3, 100.0, 200.0, 1e6, 7.0, 30, 50),       # already reached: age = current
         (4, 0.0, 200.0, 0.0, 7.0, 30, 50)],        # expense 0: number 0 -> never
        "id int, monthly_expense double, monthly_income double, current_savings double, annual_return_pct double, "
        "current_age int, target_age int")
    out = {r.id: r for r in FI.fire_plan(df, by=["id"]).collect()}
    assert out[1].fire_age is None and out[1].monthly_contribution == 0.0
    assert out[2].fire_month == 150 and out[2].fire_age == 42.5
    assert out[3].fire_month == 0 and out[3].years_to_fire == 0.0
    assert out[4].fire_age is None
    rs = {r.scenario: r.annual_return_pct for r in FI.fire_return_scenarios(
        df.where("id = 2").withColumn("annual_return_pct", F.lit(1.0)), by=["id"]).collect()}
    assert rs["Conservative (-2pp)"] == 0.0 and rs["Aggressive (+2pp)"] == 3.0
    ws = {r.withdrawal_rate_pct: (r.fire_number, r.is_default_25x) for r in FI.fire_withdrawal_scenarios(df.where("id = 2"), by=["id"]).collect()}
    assert ws[4.0] == (300000.0, True) and ws[3.0][0] == 400000.0 and ws[5.0][1] is False


def test_projection_matches_recurrence(spark):
    df = spark.createDataFrame([(1, 1500.0, 4000.0, 1000.0, 7.0, 30, 33)],
                               "id int, monthly_expense double, monthly_income double, current_savings double, "
                               "annual_return_pct double, current_age int, target_age int")
    got = [r.portfolio_value for r in FI.fire_projection(df, by=["id"]).orderBy("month").collect()]
    r = 1.07 ** (1 / 12) - 1
    bal, want = 1000.0, []
    for _ in range(37):
        want.append(bal)
        bal = bal * (1 + r) + 2500.0
    assert len(got) == 37
    assert all(abs(g - w) <= 0.011 for g, w in zip(got, want))


def test_whatif_cases(make_ledger):
    led = make_ledger([
        tx("2025-01-05", "Job", "Income", "a", 1000),
        tx("2025-01-06", "Groceries", "Expense", "a", 300),
        tx("2025-01-07", "Food court", "Expense", "a", 100),
        tx("2025-02-06", "Rent", "Expense", "a", 500),
        tx("2025-02-07", "Job", "Income", "a", 1000),
    ])
    scen = SC.DEFAULT_SCENARIOS + (
        SC.Scenario("Big savings", "increase_savings", amount=10_000.0),
        SC.Scenario("Invest at 0%", "increase_investment", amount=100.0, annual_return_pct=0.0, months_forward=1),
    )
    out = {r.scenario: r for r in SC.scenario_results(led, scen).collect()}
    base = out["Reduce Food Spending"]
    assert base.baseline_monthly_income == 1000.0 and base.baseline_monthly_expense == 450.0
    # 'Groceries' (300) outranks 'Food court' (100); both match the food keywords
    assert base.target_category == "Groceries"
    assert base.adjusted_monthly_expense == round(450 - 150 * 0.10, 2)
    assert out["Reduce Shopping Spending"].target_category is None
    assert out["Reduce Shopping Spending"].adjusted_monthly_expense == 450.0
    assert out["Big savings"].adjusted_monthly_expense == 0.0
    assert out["Increase Income"].adjusted_monthly_income == 1050.0
    inv = out["Invest at 0%"]
    assert inv.future_value_after_months == 100.0 and inv.investment_growth == 0.0
    assert inv.adjusted_net_monthly == 550.0 - 100.0
    inv7 = out["Increase Investment Amount"]
    r = 1.07 ** (1 / 12) - 1
    fv = 0.0
    for _ in range(12):
        fv = fv * (1 + r) + 50.0
    assert inv7.future_value_after_months == round(fv, 2)
    proj = SC.whatif_projection(SC.whatif_scenarios(led, scen)).where("scenario = 'Increase Income'").orderBy("month").collect()
    assert len(proj) == 13 and proj[12].adjusted_cumulative_net == round((1050 - 450) * 12, 2)


def test_options_of_the_planner_against_its_loop(spark):
    """Nominal compounding and inflation (D6), month by month."""
    rows = [(i, e, inc, s, r, 30, 60) for i, (e, inc, s, r) in enumerate(itertools.product([500.0, 2500.0], [1000.0, 4000.0], [0.0, 50000.0], [0.0, 7.0, 15.0]))]
    df = spark.createDataFrame(rows, "i int, monthly_expense double, monthly_income double, current_savings double, "
                                     "annual_return_pct double, current_age int, target_age int").withColumn("withdrawal_rate_pct", F.lit(4.0))
    for compounding, inflation in (("nominal", None), ("nominal", 2.5), ("effective", 3.0)):
        got = {r.i: r.fire_month for r in FI.fire_plan(df, ["i"], compounding, inflation).collect()}
        last = {r.i: r.portfolio_value for r in FI.fire_projection(df, ["i"], compounding, inflation).where("month = 360").collect()}
        for i, e, inc, s, pct, a, t in rows:
            pct = ((1 + pct / 100) / (1 + (inflation or 0) / 100) - 1) * 100
            r = pct / 1200 if compounding == "nominal" else (1 + pct / 100) ** (1 / 12) - 1
            bal, hit = s, None
            for m in range((t - a) * 12 + 1):
                hit = m if hit is None and bal >= e * 300 else hit
                end, bal = bal, bal * (1 + r) + max(inc - e, 0)
            assert got[i] == hit and abs(last[i] - end) < 0.02, (i, compounding, inflation)

"""Scenarios from a table: joined, whatever its size; one scan and one exchange over raw rows."""

from pyspark.sql import functions as F

from conftest import tx
from ledgerlake.operators import scenario as SC
from ledgerlake.plans.queries import REGISTRY, WHATIF_SCENARIOS

SF = "/root/testdata/sf0.001"
FIELDS = "name string, kind string, pct double, amount double, annual_return_pct double, months_forward int, keywords array<string>"


def table_of(spark, scenarios):
    rows = [(s.name, s.kind, float(s.pct), float(s.amount), float(s.annual_return_pct), s.months_forward, list(s.keywords)) for s in scenarios]
    return spark.createDataFrame(rows, FIELDS)


def ledger(make_ledger):
    rows = []
    for e in range(5):
        for m in (1, 2, 3):
            rows += [tx(f"2025-0{m}-01", "Food shop", "Expense", "a", 10 + e, e), tx(f"2025-0{m}-02", "Groceries", "Expense", "a", 10 + e, e),
                     tx(f"2025-0{m}-03", "Job", "Income", "a", 90, e), tx(f"2025-0{m}-04", "Rent", "Expense", "a", 30, e)]
    return make_ledger([*rows, tx("2025-01-01", "Job", "Income", "a", 5, 99)])


def test_table_equals_list(spark, make_ledger):
    led, scenarios = ledger(make_ledger), sorted(WHATIF_SCENARIOS, key=lambda s: s.name)
    for by in ((), ("entity_id",)):
        want = sorted(map(str, SC.scenario_results(led, scenarios, by=by).collect()))
        got = SC.scenario_results(led, table_of(spark, reversed(scenarios)), by=by)
        assert sorted(map(str, got.collect())) == want
        assert got.count() == len(scenarios) * (5 if by else 1)  # an entity without expenses has no rows


def test_ties_of_categories_and_empty_tables(spark, make_ledger):
    led = ledger(make_ledger)
    picks = SC.scenario_results(led, [SC.Scenario("x", "reduce_category", pct=10, keywords=("o",))], by=["entity_id"])
    assert {r.target_category for r in picks.collect()} == {"Food shop"}  # equal totals: by name
    none = SC.scenario_results(led, [SC.Scenario("x", "reduce_category", pct=10)])
    assert none.first().target_category is None and none.first().net_monthly_change == 0
    assert SC.scenario_results(led, table_of(spark, [])).count() == 0
    assert SC.scenario_results(led.limit(0), table_of(spark, WHATIF_SCENARIOS), by=["entity_id"]).count() == 0


def test_many_scenarios_are_joined_not_collected(spark, make_ledger, monkeypatch):
    n = 100_000
    table = spark.range(n).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.lit("increase_income").alias("kind"),
                                  (F.col("id") / 1000).alias("pct"))
    led = ledger(make_ledger)
    collect = type(led).collect
    seen = []
    monkeypatch.setattr(type(led), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    out = SC.scenario_results(led, table, by=["entity_id"])
    monkeypatch.undo()
    assert max((len(x) for x in seen), default=0) < 1000  # partition sums of the numbering, not scenarios
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    got = out.agg(F.count("*").alias("n"), F.count_distinct("scenario_id").alias("ids"), F.max("scenario_id").alias("last")).first()
    assert (got.n, got.ids, got.last) == (5 * n, n, n - 1)
    row = out.where("scenario_id = 50000 and entity_id = 0").first()
    assert row.scenario == "s050000" and row.adjusted_monthly_income == 135.0


def test_one_scan_of_the_ledger(spark):
    df = REGISTRY["whatif_scenarios"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "Join" not in text

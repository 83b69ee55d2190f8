"""What-if scenarios over (entity x scenario).

The source evaluates one scenario for one household on the driver. Here all
that scenarios need of a ledger is one row per entity: its exact sums, its months
and its expense categories with their totals, largest first; rows are aggregated
by (entity, category, month) once, and those aggregates twice more. A list of
scenarios is attached to it with ``explode`` of a literal array; a table of
scenarios, of any size, is joined in chunks: the keys of that join are (chunk,
salt), as many salts as shuffle partitions, so no key is hot and neither
side is collected. Scenario figures are column expressions over the one row.

Baseline (C6): n = months present (>= 1); monthly income = income / n; monthly
expense = expense-category total / n; net = income - expense. Entities without
expense rows get no scenario rows (the source stops there).

Scenario kinds (C7-C11):

* ``reduce_category``: the highest-spend expense category whose lower-cased
  name contains any keyword is cut by ``pct`` %; no match -> no effect.
* ``increase_savings``: every category scaled by max(0, (E - amount) / E), if E > 0.
* ``increase_investment``: net - amount; the amount compounds monthly at
  r = (1 + R/100)^(1/12) - 1 for ``months_forward`` months (closed form).
* ``increase_income``: income x (1 + pct/100).
* ``one_time_expense`` (design-doc item D5): a single outlay of ``amount`` in
  month 1; the monthly figures are unchanged, the cumulative net is lower by it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round_dec
from ..functions.filters import apply_filter
from ..functions.ranking import running_weight
from .fire import future_value, rate, with_powers
from .summary import EXPENSE, expense_amt, income_amt


@dataclass(frozen=True)
class Scenario:
    name: str
    kind: str
    pct: float = 0.0
    amount: float = 0.0
    annual_return_pct: float = 0.0
    months_forward: int = 12
    keywords: tuple = field(default_factory=tuple)


# The five scenarios of the simulator with their page defaults and
# category keywords ("food", "grocer" and "shop", "retail").
DEFAULT_SCENARIOS = (
    Scenario("Reduce Food Spending", "reduce_category", pct=10, keywords=("food", "grocer")),
    Scenario("Reduce Shopping Spending", "reduce_category", pct=10, keywords=("shop", "retail")),
    Scenario("Increase Savings", "increase_savings", amount=0.0),
    Scenario("Increase Investment Amount", "increase_investment", amount=50.0, annual_return_pct=7.0),
    Scenario("Increase Income", "increase_income", pct=5),
)

SCENARIO_TYPE = ("array<struct<scenario_id:int,scenario:string,kind:string,pct:double,amount:double,"
                 "annual_return_pct:double,months_forward:int,keywords:array<string>>>")


CHUNK = 1000  # scenarios of a table that travel together


def scenario_list(scenarios: Sequence[Scenario] | DataFrame) -> list[Scenario]:
    """Scenarios given as a list, or as a table with the fields of ``Scenario`` (read on the driver: for small tables)."""
    if not isinstance(scenarios, DataFrame):
        return list(scenarios)
    names = [f for f in Scenario.__dataclass_fields__ if f in scenarios.columns]
    rows = [{n: r[n] for n in names if r[n] is not None} for r in scenarios.select(*names).collect()]
    return [Scenario(**(r | ({"keywords": tuple(r["keywords"])} if "keywords" in r else {}))) for r in rows]


def scenario_array(scenarios: Sequence[Scenario]) -> Column:
    """The scenario list as one literal array column."""
    items = [
        {"scenario_id": i, "scenario": s.name, "kind": s.kind, "pct": float(s.pct), "amount": float(s.amount),
         "annual_return_pct": float(s.annual_return_pct), "months_forward": int(s.months_forward),
         "keywords": [k.lower() for k in s.keywords]}
        for i, s in enumerate(scenarios)
    ]
    return F.from_json(F.lit(json.dumps(items)), SCENARIO_TYPE)


def scenario_table(scenarios: DataFrame) -> tuple[DataFrame, int]:
    """A table with fields of ``Scenario`` as structs ``sc`` like those of ``scenario_array``, and its number of rows.

    Without a column ``scenario_id`` scenarios are numbered from 0 by name, then kind.
    """
    fields = {"kind": "string", "pct": "double", "amount": "double", "annual_return_pct": "double", "months_forward": "int", "keywords": "array<string>"}
    unset = {"kind": "''", "pct": "0", "amount": "0", "annual_return_pct": "0", "months_forward": "12", "keywords": "array()"}
    cols = [F.coalesce(F.col(f).cast(t), F.expr(unset[f]).cast(t)).alias(f) if f in scenarios.columns else F.expr(unset[f]).cast(t).alias(f)
            for f, t in fields.items()]
    given = ["scenario_id"] if "scenario_id" in scenarios.columns else []
    rows = scenarios.select(*given, F.col("name").alias("scenario"), *cols)
    if given:
        total = rows.count()
    else:
        rows, total = running_weight(rows, ["scenario", "kind"], out="scenario_id")
    lower = F.transform("keywords", lambda k: F.lower(k)).alias("keywords")
    whole = F.struct(F.col("scenario_id").cast("int").alias("scenario_id"), "scenario", *[f for f in fields if f != "keywords"], lower)
    return rows.select(whole.alias("sc")), total


def _with_scenarios(base: DataFrame, scenarios: Sequence[Scenario] | DataFrame) -> DataFrame:
    """Every row of ``base`` with every scenario, as ``sc``."""
    if not isinstance(scenarios, DataFrame):
        return base.select("*", F.explode(scenario_array(list(scenarios))).alias("sc"))
    table, total = scenario_table(scenarios)
    chunks, salts = -(-total // CHUNK), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    parts = table.groupBy(F.pmod(F.xxhash64("sc"), F.lit(max(chunks, 1))).cast("int").alias("_chunk")).agg(F.collect_list("sc").alias("_scs"))
    parts = parts.select("_chunk", "_scs", to(salts).alias("_salt"))
    keyed = base.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in base.columns if c != "cats"]), F.lit(salts)).cast("int"))
    keyed = keyed.select("*", to(chunks).alias("_chunk"))
    return keyed.join(parts, ["_chunk", "_salt"]).select(*base.columns, F.explode("_scs").alias("sc"))


def baseline(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: exact income and expense totals, months present, and expense categories with their totals, largest first."""
    df = apply_filter(ledger, filters)
    cells = df.groupBy(*by, "category", "year_month").agg(
        F.sum(income_amt()).alias("_inc"), F.sum(expense_amt()).alias("_exp"), F.count_if(F.col("type") == EXPENSE).alias("_n"))
    cats = cells.groupBy(*by, "category").agg(
        F.sum("_inc").alias("_inc"), F.sum("_exp").alias("_exp"), F.sum("_n").alias("_n"), F.collect_set("year_month").alias("_months"))
    spent = F.struct((-F.col("_exp")).alias("less"), "category", F.col("_exp").alias("t"))
    return cats.groupBy(*by).agg(
        F.sum("_inc").alias("s_inc"),
        F.sum("_exp").alias("s_exp"),
        F.sum("_n").alias("n_exp_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_months")))).alias("n_months"),
        # largest total first, ties by name
        F.sort_array(F.collect_list(F.when(F.col("_n") > 0, spent))).alias("cats"),
    )


def whatif_scenarios(ledger: DataFrame, scenarios: Sequence[Scenario] | DataFrame = DEFAULT_SCENARIOS, filters=None,
                     by: Sequence[str] = (), compounding: str = "effective", inflation_pct: float | None = None) -> DataFrame:
    """One row per (by, scenario) with the ten rounded figures of the scenario record.

    ``compounding`` and ``inflation_pct`` (D6) are those of ``fire.rate``, for investments.
    """
    base = baseline(ledger, filters, by).where(F.col("n_exp_rows") > 0)
    named = lambda c: F.exists(F.col("sc.keywords"), lambda k: F.contains(F.lower(c["category"]), k))
    pick = F.when(F.col("sc.kind") == "reduce_category", F.get(F.filter("cats", named), 0))
    grid = _with_scenarios(base, scenarios).select(*by, "s_inc", "s_exp", "n_months", "sc.*", pick.alias("_pick"))
    grid = grid.withColumn("target_category", F.col("_pick.category")).withColumn("pick_t", F.col("_pick.t")).drop("_pick")
    n = F.greatest(F.col("n_months"), F.lit(1))
    inc = F.col("s_inc").cast("double") / n
    exp = F.col("s_exp").cast("double") / n
    net = inc - exp
    kind = F.col("kind")
    pct = F.col("pct") / F.lit(100.0)
    adj_inc = F.when(kind == "increase_income", inc * (F.lit(1.0) + pct)).otherwise(inc)
    pick_monthly = F.col("pick_t").cast("double") / n
    factor = F.greatest(F.lit(0.0), (exp - F.col("amount")) / exp)
    adj_exp = (
        F.when((kind == "reduce_category") & F.col("pick_t").isNotNull(), exp - pick_monthly * pct)
        .when((kind == "increase_savings") & (exp > 0), exp * factor)
        .otherwise(exp)
    )
    is_inv = kind == "increase_investment"
    once = F.when((kind == "one_time_expense") & (F.col("months_forward") >= 1), F.col("amount")).otherwise(F.lit(0.0))
    adj_net = F.when(is_inv, net - F.col("amount")).otherwise(adj_inc - adj_exp)
    h = F.col("months_forward")
    r = rate("annual_return_pct", compounding, inflation_pct)
    fv = future_value("amount", r, h)
    out = with_powers(grid, F.lit(1.0) + r).select(
        *by,
        "scenario_id",
        "scenario",
        "months_forward",
        F.when(kind == "reduce_category", F.col("target_category")).alias("target_category"),
        round_dec(inc).alias("baseline_monthly_income"),
        round_dec(exp).alias("baseline_monthly_expense"),
        round_dec(adj_inc).alias("adjusted_monthly_income"),
        round_dec(adj_exp).alias("adjusted_monthly_expense"),
        round_dec(net).alias("baseline_net_monthly"),
        round_dec(adj_net).alias("adjusted_net_monthly"),
        round_dec(adj_net - net).alias("net_monthly_change"),
        round_dec(net * h).alias("baseline_cumulative_net"),
        round_dec(adj_net * h - once).alias("adjusted_cumulative_net"),
        F.when(is_inv, round_dec(fv)).alias("future_value_after_months"),
        F.when(is_inv, round_dec(F.col("amount") * h)).alias("total_contributed"),
        F.when(is_inv, round_dec(fv - F.col("amount") * h)).alias("investment_growth"),
        net.alias("_net"),
        adj_net.alias("_adj_net"),
        F.when(kind == "one_time_expense", F.col("amount")).otherwise(F.lit(0.0)).alias("_once"),
        F.when(is_inv, F.col("amount")).alias("_invested"),
        F.when(is_inv, r).alias("_rate"),
    )
    return out


def investment_path(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value of the investment after each month 1..H (C11), of the investment scenarios among ``whatif_scenarios``.

    The rate's powers are computed once per (by, scenario), before its months are generated.
    """
    x = with_powers(results.where(F.col("_invested").isNotNull() & (F.col("months_forward") >= 1)), F.lit(1.0) + F.col("_rate"))
    x = x.select("*", F.explode(F.sequence(F.lit(1), F.col("months_forward"))).alias("month"))
    value = future_value("_invested", "_rate", "month")
    return x.select(*by, "scenario_id", "scenario", "month", round_dec(value).alias("investment_value"),
                    round_dec(F.col("_invested") * F.col("month")).alias("contributed"))


def whatif_projection(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative net for months 0..H, baseline and adjusted (C12); rows = (by, scenario) x (H + 1)."""
    x = results.select(*by, "scenario_id", "scenario", "_net", "_adj_net", "_once",
                       F.explode(F.sequence(F.lit(0), F.col("months_forward"))).alias("month"))
    once = F.when(F.col("month") >= 1, F.col("_once")).otherwise(F.lit(0.0))
    return x.select(
        *by, "scenario_id", "scenario", "month",
        round_dec(F.col("_net") * F.col("month")).alias("baseline_cumulative_net"),
        round_dec(F.col("_adj_net") * F.col("month") - once).alias("adjusted_cumulative_net"),
    )


def scenario_results(ledger: DataFrame, scenarios: Sequence[Scenario] | DataFrame = DEFAULT_SCENARIOS, filters=None,
                     by: Sequence[str] = (), compounding: str = "effective", inflation_pct: float | None = None) -> DataFrame:
    """``whatif_scenarios`` without the internal columns."""
    return whatif_scenarios(ledger, scenarios, filters, by, compounding, inflation_pct).drop(
        "_net", "_adj_net", "_once", "_invested", "_rate")

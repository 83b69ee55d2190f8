"""Aggregate-only context packages.

Three shapes, one JSON document per entity each: the financial context
(period, filters, totals, monthly summary, top 5 expense and top 3 income
categories, trends, accounts, health score with its weights, budget status;
optionally macro indicators, a profiling summary and recent metrics), the
what-if context (one document per scenario) and the FIRE context. Row-level
data never enters: every section is built from an aggregate and its schema is
checked for row-level field names.

Each list is bounded by the entity's months, accounts or planned categories
(top-k lists by k), never by its number of transactions. Without entity keys
the single document lists every month, account and planned category of the
whole ledger: right for one household (the source's use); for a multi-tenant
ledger use ``by=`` (one bounded document per entity) and the breakdown tables.

Plan: one (entity, month, category, type, account) pre-aggregate is dealt by
entity once; sections group and rank within entities, so they need no further
exchange, and Spark reuses that one. Nothing is computed before an action.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.assemble import json_document
from ..functions.exprs import round_dec
from ..functions.ranking import stored
from ..functions.filters import LedgerFilter
from ..operators import budget as BU
from ..operators import fire as FI
from ..operators import health as HE
from ..operators import scenario as SC
from ..operators import summary as S
from ..operators import trends as TR

# Columns that identify single transactions; none may appear in a context package.
ROW_LEVEL_FIELDS = frozenset({"transaction_id", "transaction_date", "transaction_datetime", "tags", "ingested_at", "source"})


def assert_aggregate_only(schema: T.DataType, path: str = "") -> None:
    """Raise ValueError if any (nested) field name is a row-level column."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            if f.name in ROW_LEVEL_FIELDS:
                raise ValueError(f"row-level field in context package: {path}{f.name}")
            assert_aggregate_only(f.dataType, f"{path}{f.name}.")
    elif isinstance(schema, T.ArrayType):
        assert_aggregate_only(schema.elementType, path)
    elif isinstance(schema, T.MapType):
        assert_aggregate_only(schema.valueType, path)


def _dealt(ledger: DataFrame, spec: LedgerFilter, by: Sequence[str]) -> DataFrame:
    """The pre-aggregate, written once when called: the ledger is read once, whatever the sections read of it."""
    base = S.preaggregate(ledger, spec, by)
    return stored(base.repartition(*by) if by else base, "context")


def _r2(df: DataFrame, keep: Sequence[str] = ("_rn",)) -> DataFrame:
    return df.select(*[(round_dec(f.name, 2).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keep
                        else F.col(f.name)) for f in df.schema.fields])


def _top(base: DataFrame, by: Sequence[str], type_: str, n: int) -> DataFrame:
    cats = base.where(F.col("type") == type_).groupBy(*by, "category").agg(
        F.sum("amount").cast("double").alias("total_amount"), S.n_rows(base).alias("transaction_count"))
    w = Window.partitionBy(*by).orderBy(F.col("total_amount").desc(), F.col("category").asc())
    return cats.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def _overview(base: DataFrame, by: Sequence[str]) -> DataFrame:
    return S.kpi_totals(base, by=by).select(*by, F.struct(
        F.col("months_covered"),
        F.struct(round_dec("total_income").alias("total_income"), round_dec("total_expense").alias("total_expense"),
                 round_dec("net").alias("net")).alias("totals"),
        F.col("savings_rate_pct"),
    ).alias("overview"))


def _health(base: DataFrame, by: Sequence[str]) -> DataFrame:
    health = HE.health_score(base, by=by, snapshot=True)
    weights = F.struct(*[F.lit(w).alias(k) for k, w in HE.WEIGHTS.items()]).alias("weights")
    return health.select(*by, F.struct(*[c for c in health.columns if c not in by], weights).alias("financial_health_score"))


def _documents(sections: list[tuple], by: Sequence[str], shared: dict[str, DataFrame | None], out: str = "context_json") -> DataFrame:
    """One JSON object per entity of ``sections``, with the one-row frames ``shared`` as further members of each."""
    for sec in sections:
        assert_aggregate_only(sec[1].select(sec[0]).schema if sec[2] == "object" else sec[1].schema)
    doc = json_document(sections, by, out=out)
    for name, frame in shared.items():
        if frame is None:
            continue
        assert_aggregate_only(frame.schema)
        text = frame.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*frame.columns)))).alias("j")).scalar()
        body = F.col(out).substr(F.lit(1), F.length(out) - 1)
        doc = doc.withColumn(out, F.concat(body, F.lit(f',"{name}":'), F.coalesce(text, F.lit("[]")), F.lit("}")))
    return doc


def financial_context(ledger: DataFrame, filters=None, by: Sequence[str] = (), plans: DataFrame | None = None,
                      macro: DataFrame | None = None, profiling: DataFrame | None = None,
                      recent: DataFrame | None = None) -> DataFrame:
    """One row per entity: ``by`` columns + ``context_json``.

    ``macro`` (indicators), ``profiling`` (the condensed profile) and ``recent``
    (newest months of the summary table) are small tables about the whole
    ledger; each becomes a list member of every document. An entity without
    ledger rows has no document.
    """
    spec = LedgerFilter.of(filters)
    by = list(by)
    base = _dealt(ledger, spec, by)
    # one (entity, month) aggregate feeds both the monthly summary and the trends
    m = base.groupBy(*by, "year_month").agg(
        F.sum(S.income_amt()).alias("_inc"), F.sum(S.expense_amt()).alias("_exp"),
        F.sum(S.signed_amt()).alias("_net"), S.n_rows(base).alias("transaction_count"))
    monthly = m.select(
        *by, "year_month", F.col("_inc").cast("double").alias("total_income"),
        F.col("_exp").cast("double").alias("total_expense"), F.col("_net").cast("double").alias("net"),
        "transaction_count",
    ).withColumn("savings_rate_pct", S.savings_rate("net", "total_income"))
    trends = TR.trends_from_monthly(m, by)
    overview = _overview(base, by)
    listed = lambda v: F.from_json(F.lit(json.dumps(list(v))), "array<string>") if v else F.lit(None).cast("array<string>")
    period = F.struct(F.lit(spec.start_ym).cast("string").alias("start"), F.lit(spec.end_ym).cast("string").alias("end"))
    filters_used = F.struct(listed(spec.accounts).alias("accounts"), listed(spec.categories).alias("categories"))
    sections = [
        ("period", overview.select(*by, period.alias("period")), "object"),
        ("filters", overview.select(*by, filters_used.alias("filters")), "object"),
        ("overview", overview, "object"),
        ("monthly_summary", _r2(monthly), "list", (None, "year_month")),
        ("top_expense_categories", _r2(_top(base, by, S.EXPENSE, 5)), "list", ("_rn", None)),
        ("top_income_categories", _r2(_top(base, by, S.INCOME, 3)), "list", ("_rn", None)),
        ("monthly_trends", _r2(trends), "list", (None, "year_month")),
        ("account_breakdown", _r2(S.account_breakdown(base, by=by)), "list", (None, "account")),
        ("financial_health_score", _health(base, by), "object"),
    ]
    if plans is not None:
        # documents exist for entities with ledger rows; their plans are compared with their spend
        if by:
            plans = plans.join(overview.select(*by), by, "left_semi")
        st = BU.budget_status(base, plans, by=by)
        over = st.where("over_rank is not null").select(*by, "category", F.col("over_rank").cast("double").alias("_rn"))
        sections.append(("budget_status", _r2(st.drop("is_over")), "list", (None, "category")))
        sections.append(("over_budget_categories", over, "list", ("_rn", None)))
        sections.append(("budget_overrun", BU.over_budget_total(base, plans, by=by).select(
            *by, F.struct("total_over_budget_amount", "n_over_budget").alias("budget_overrun")), "object"))
    return _documents(sections, by, {"macro_context": macro, "profiling_summary": profiling, "recent_metrics": recent})


def whatif_context(ledger: DataFrame, scenarios=SC.DEFAULT_SCENARIOS, filters=None, by: Sequence[str] = (),
                   macro: DataFrame | None = None) -> DataFrame:
    """One row per (entity, scenario): the scenario with its parameters, its results, the baseline and the health score."""
    spec, by = LedgerFilter.of(filters), list(by)
    base = _dealt(ledger, spec, by)
    scenarios = SC.scenario_list(scenarios)
    results = SC.scenario_results(base, scenarios, by=by)
    figures = [c for c in results.columns if c not in (*by, "scenario_id", "scenario", "months_forward", "target_category")]
    listed = F.explode(SC.scenario_array(scenarios))
    params = base.sparkSession.range(1).select(listed.alias("s")).select("s.*")
    params = params.select("scenario_id", F.struct(F.col("scenario").alias("name"), F.struct(
        "kind", "pct", "amount", "annual_return_pct", "months_forward", "keywords").alias("parameters")).alias("scenario"))
    res = results.select(*by, "scenario_id", F.struct("target_category", *figures).alias("whatif_results"))
    keys = [*by, "scenario_id"]
    grid = results.select(*keys)
    each = lambda df: grid.join(df, by) if by else df.select(F.explode(F.sequence(F.lit(0), F.lit(len(scenarios) - 1))).alias("scenario_id"), "*")
    sections = [
        ("scenario", grid.join(params, "scenario_id"), "object"),
        ("whatif_results", res, "object"),
        ("baseline", each(_overview(base, by)).withColumnRenamed("overview", "baseline"), "object"),
        ("top_expense_categories", each(_r2(_top(base, by, S.EXPENSE, 5))), "list", ("_rn", None)),
        ("financial_health_score", each(_health(base, by)), "object"),
    ]
    return _documents(sections, keys, {"macro_context": macro})


def fire_context(inputs: DataFrame, by: Sequence[str] = (), macro: DataFrame | None = None) -> DataFrame:
    """One row per entity: the planner's inputs, its plan, and the return and withdrawal scenarios."""
    by = list(by)
    plan = FI.fire_plan(inputs, by)
    fields = [c for c in inputs.columns if c not in by]
    sections = [
        ("fire_inputs", inputs.select(*by, F.struct(*fields).alias("fire_inputs")), "object"),
        ("fire_results", plan.select(*by, F.struct(*[c for c in plan.columns if c not in by]).alias("fire_results")), "object"),
        ("return_scenarios", FI.fire_return_scenarios(inputs, by), "list", ("annual_return_pct", "scenario")),
        ("withdrawal_scenarios", FI.fire_withdrawal_scenarios(inputs, by), "list", ("withdrawal_rate_pct", None)),
    ]
    return _documents(sections, by, {"macro_context": macro})

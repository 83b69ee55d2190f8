"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each runs over whole tables of the given scale-factor folder. Names match the
SQL twins in ``plans.oracle``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import LedgerFilter
from ..functions.ranking import global_rank
from ..operators import anomaly as AN
from ..operators import budget as BU
from ..operators import classify as CL
from ..operators import clean as CN
from ..operators import fire as FI
from ..operators import health as HE
from ..operators import macro as MA
from ..operators import profile as PR
from ..operators import scenario as SC
from ..operators import stable_id as SI
from ..operators import summary as S
from ..operators import trends as TR
from ..session import scratch_path
from ..sources import macro as SM
from ..sources import raw_csv as RC
from ..sources import store as ST
from ..sources import testdata as TD
from ..streaming import ingest as IN
from . import context as CX
from . import etl as ETL
from . import marts as MT
from . import profiling as PF

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


FILTER_A = LedgerFilter(start_ym="1996-01", end_ym="1998-12", accounts=("F", "O"))
FILTER_B = LedgerFilter(start_ym="1997-01", end_ym="1999-06", accounts=("A", "R"))
BY = ("entity_id",)


def l1(spark, sf):
    return TD.orders_ledger(spark, sf)


def l2(spark, sf):
    return TD.lineitem_ledger(spark, sf)


def l3(spark, sf):
    return TD.events_ledger(spark, sf)


@register("monthly_summary")
def q_monthly_summary(spark, sf):
    return S.monthly_summary(l1(spark, sf))


@register("monthly_summary_filtered")
def q_monthly_summary_filtered(spark, sf):
    return S.monthly_summary(l1(spark, sf), FILTER_A)


@register("monthly_summary_by_entity")
def q_monthly_summary_by_entity(spark, sf):
    return S.monthly_summary(l1(spark, sf), by=BY)


@register("savings_rate")
def q_savings_rate(spark, sf):
    return S.monthly_summary(l2(spark, sf)).select("year_month", "savings_rate_pct")


@register("category_breakdown")
def q_category_breakdown(spark, sf):
    return S.category_breakdown(l1(spark, sf))


@register("category_breakdown_month")
def q_category_breakdown_month(spark, sf):
    return S.category_breakdown(l2(spark, sf), year_month="1997-06", type_filter="Expense")


@register("category_breakdown_filtered")
def q_category_breakdown_filtered(spark, sf):
    return S.category_breakdown(l2(spark, sf), FILTER_B)


@register("top_categories")
def q_top_categories(spark, sf):
    return S.top_categories(l2(spark, sf), n=5, type_filter="Expense")


@register("top_categories_filtered")
def q_top_categories_filtered(spark, sf):
    # the filter's own ``types`` would be replaced by the type argument
    return S.top_categories(l2(spark, sf), n=3, type_filter="Income", filters=FILTER_B.with_types(["Expense"]))


@register("top_categories_by_entity")
def q_top_categories_by_entity(spark, sf):
    return S.top_categories(l2(spark, sf), n=3, type_filter="Expense", by=BY)


@register("account_breakdown")
def q_account_breakdown(spark, sf):
    return S.account_breakdown(l1(spark, sf))


@register("account_breakdown_filtered")
def q_account_breakdown_filtered(spark, sf):
    return S.account_breakdown(l2(spark, sf), FILTER_B)


@register("date_range")
def q_date_range(spark, sf):
    return S.date_range(l1(spark, sf))


@register("type_totals")
def q_type_totals(spark, sf):
    return S.type_totals(l2(spark, sf))


@register("filter_values")
def q_filter_values(spark, sf):
    return S.filter_values(l1(spark, sf))


@register("filtered_transactions")
def q_filtered_transactions(spark, sf):
    df = S.filtered_transactions(l1(spark, sf), FILTER_A, limit=500)
    return df.select("transaction_id", "transaction_date", "year", "month", "year_month", "category", "type",
                     "account", F.col("amount").cast("double").alias("amount"), "currency", "source")


@register("kpi_totals")
def q_kpi_totals(spark, sf):
    return S.kpi_totals(l1(spark, sf))


@register("kpi_totals_by_entity")
def q_kpi_totals_by_entity(spark, sf):
    return S.kpi_totals(l2(spark, sf), by=BY)


@register("recent_12_months")
def q_recent_12_months(spark, sf):
    return S.recent_months(S.monthly_summary(l1(spark, sf)), 12)


# --- trends and anomalies -------------------------------------------------


@register("monthly_trends")
def q_monthly_trends(spark, sf):
    return TR.monthly_trends(l1(spark, sf))


@register("monthly_trends_filtered")
def q_monthly_trends_filtered(spark, sf):
    return TR.monthly_trends(l1(spark, sf), FILTER_A)


@register("monthly_trends_by_entity")
def q_monthly_trends_by_entity(spark, sf):
    return TR.monthly_trends(l2(spark, sf), by=BY)


@register("rolling_avg_n")
def q_rolling_avg_n(spark, sf):
    return TR.monthly_trends(l2(spark, sf), rolling=(3, 6, 12))


@register("running_totals")
def q_running_totals(spark, sf):
    return TR.monthly_trends(l1(spark, sf), FILTER_A, rolling=(), running=True)


@register("anomalies")
def q_anomalies(spark, sf):
    return AN.detect_anomalies(l1(spark, sf), 2.0)


@register("anomalies_by_entity")
def q_anomalies_by_entity(spark, sf):
    return AN.detect_anomalies(l2(spark, sf), 2.0, by=BY)


@register("category_share")
def q_category_share(spark, sf):
    return TR.category_share(l2(spark, sf))


@register("yearly_trends")
def q_yearly_trends(spark, sf):
    return TR.yearly_trends(l1(spark, sf))


# --- health score and budget ----------------------------------------------


@register("health_score")
def q_health_score(spark, sf):
    return HE.health_score(l1(spark, sf))


@register("health_score_snapshot")
def q_health_score_snapshot(spark, sf):
    return HE.health_score(l1(spark, sf), snapshot=True)


@register("health_score_by_entity")
def q_health_score_by_entity(spark, sf):
    return HE.health_score(l1(spark, sf), by=BY, snapshot=True)


@register("health_score_display_by_entity")
def q_health_score_display_by_entity(spark, sf):
    return HE.health_score(l2(spark, sf), by=BY)


def plans(spark, sf):
    return TD.customer_budget_plans(spark, sf)


@register("budget_status")
def q_budget_status(spark, sf):
    return BU.budget_status(l1(spark, sf), plans(spark, sf).drop("entity_id"), FILTER_A)


@register("budget_status_by_entity")
def q_budget_status_by_entity(spark, sf):
    return BU.budget_status(l1(spark, sf), plans(spark, sf), by=BY)


@register("over_budget_total")
def q_over_budget_total(spark, sf):
    return BU.over_budget_total(l1(spark, sf), plans(spark, sf), by=BY)


# --- what-if and FIRE -------------------------------------------------------

# The simulator's five scenarios plus one whose keywords match this ledger's
# category names, so that the category-pick path runs on real rows too.
WHATIF_SCENARIOS = SC.DEFAULT_SCENARIOS + (
    SC.Scenario("Reduce Low-Priority Spending", "reduce_category", pct=20, months_forward=24, keywords=("low", "specified")),
    SC.Scenario("One-time Purchase", "one_time_expense", amount=5000.0, months_forward=36),
)


@register("whatif_scenarios")
def q_whatif_scenarios(spark, sf):
    return SC.scenario_results(l1(spark, sf), WHATIF_SCENARIOS, by=BY)


@register("whatif_baseline")
def q_whatif_baseline(spark, sf):
    return SC.scenario_results(l2(spark, sf), SC.DEFAULT_SCENARIOS[:1], by=BY).select(
        *BY, "baseline_monthly_income", "baseline_monthly_expense", "baseline_net_monthly")


@register("whatif_projection")
def q_whatif_projection(spark, sf):
    res = SC.whatif_scenarios(l1(spark, sf), WHATIF_SCENARIOS, by=BY)
    return SC.whatif_projection(res, by=BY)


@register("investment_growth")
def q_investment_growth(spark, sf):
    inv = (SC.Scenario("Invest 10%", "increase_investment", amount=100.0, annual_return_pct=7.0, months_forward=36),
           SC.Scenario("Invest at 0%", "increase_investment", amount=100.0, annual_return_pct=0.0, months_forward=12))
    return SC.scenario_results(l2(spark, sf), inv, by=BY).select(
        *BY, "scenario", "future_value_after_months", "total_contributed", "investment_growth", "adjusted_net_monthly")


INVESTMENTS = (
    SC.Scenario("Invest", "increase_investment", amount=100.0, annual_return_pct=7.0, months_forward=36),
    SC.Scenario("Invest at 0%", "increase_investment", amount=50.0, annual_return_pct=0.0, months_forward=12),
    SC.Scenario("No investment", "increase_income", pct=5.0, months_forward=12),
)


@register("investment_path")
def q_investment_path(spark, sf):
    res = SC.whatif_scenarios(l2(spark, sf), INVESTMENTS, by=BY)
    return SC.investment_path(res, by=BY)


@register("investment_path_real")
def q_investment_path_real(spark, sf):
    """Nominal monthly compounding of a return adjusted for 2.5 % inflation."""
    res = SC.whatif_scenarios(l2(spark, sf), INVESTMENTS, by=BY, compounding="nominal", inflation_pct=2.5)
    return SC.investment_path(res, by=BY)


def fire_inputs(spark, sf):
    return FI.planner_inputs(l1(spark, sf), by=BY)


@register("fire_age")
def q_fire_age(spark, sf):
    return FI.fire_plan(fire_inputs(spark, sf), by=BY)


@register("fire_age_real")
def q_fire_age_real(spark, sf):
    """The plan with nominal monthly compounding and 2.5 % inflation."""
    return FI.fire_plan(fire_inputs(spark, sf), by=BY, compounding="nominal", inflation_pct=2.5)


@register("fire_return_scenarios")
def q_fire_return_scenarios(spark, sf):
    return FI.fire_return_scenarios(fire_inputs(spark, sf), by=BY)


@register("fire_withdrawal_scenarios")
def q_fire_withdrawal_scenarios(spark, sf):
    return FI.fire_withdrawal_scenarios(fire_inputs(spark, sf), by=BY)


@register("fire_projection")
def q_fire_projection(spark, sf):
    return FI.fire_projection(fire_inputs(spark, sf), by=BY)


# --- cleaning and ids ---------------------------------------------------------


@register("clean_ledger")
def q_clean_ledger(spark, sf):
    raw = TD.lineitem_raw_log(spark, sf)
    df = CN.clean_transactions(raw, source="lineitem", mapping=TD.LINEITEM_MAPPING)
    return df.drop("ingested_at").withColumn("amount", F.col("amount").cast("double"))


@register("extract_log")
def q_extract_log(spark, sf):
    """CSV files written from the log, with quotes, commas and line breaks in fields and two orders of columns, read back."""
    root = scratch_path(spark, "raw-log")
    log = TD.lineitem_raw_log(spark, sf)
    text = F.when(F.substring("date_time", 10, 1).isin("1", "4", "7"), F.concat("category", F.lit('\nsays "well, yes",\n'), "tags")).otherwise(F.col("category"))
    log = log.withColumn("category", text)
    options = {"header": True, "escape": '"', "lineSep": "\n", "compression": "gzip"}
    log.write.options(**options).csv(f"{root}/a")
    log.select(*reversed(log.columns), F.lit("x").alias("note")).write.options(**options).csv(f"{root}/b")
    return RC.extract_transactions(spark, f"{root}/*").groupBy("category", "account", "currency", "tags", "note").agg(
        F.count(F.lit(1)).alias("n"), F.min("date_time").alias("first"), F.max("date_time").alias("last"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


@register("clean_dirty_ledger")
def q_clean_dirty_ledger(spark, sf):
    """The log with bad dates, bad and unfit amounts, padding, signs and missing tags: what is kept."""
    df = CN.clean_transactions(TD.lineitem_dirty_log(spark, sf), source="lineitem", mapping=TD.LINEITEM_MAPPING)
    return df.drop("ingested_at").withColumn("amount", F.col("amount").cast("double"))


@register("rejected_rows")
def q_rejected_rows(spark, sf):
    """What is not kept, and why."""
    return CN.rejected_transactions(TD.lineitem_dirty_log(spark, sf))


@register("etl_summary")
def q_etl_summary(spark, sf):
    """The whole job over the dirty log: the summary table that it writes, with what was rejected."""
    root = scratch_path(spark, "etl")
    res = ETL.run_etl(spark, "", root, source="lineitem", mapping=TD.LINEITEM_MAPPING, raw=TD.lineitem_dirty_log(spark, sf))
    if res["errors"]:
        raise RuntimeError(str(res["errors"]))
    return ST.read_current(spark, res["monthly_summary_path"]).select(
        "year_month", "total_income", "total_expense", "net", "transaction_count", "savings_rate_pct",
        F.lit(res["rows_out"]).cast("long").alias("rows_out"), F.lit(res["rejected"]).cast("long").alias("rejected"))


@register("stable_ids")
def q_stable_ids(spark, sf):
    # hashing only (date_time, account, tags) leaves ~4 copies per text: occurrence numbering does the work
    raw = TD.lineitem_raw_log(spark, sf).select("date_time", "account", "tags")
    return SI.assign_stable_ids(raw, ["date_time", "account", "tags"])


@register("type_classification")
def q_type_classification(spark, sf):
    brands = TD.read_table(spark, sf, "part").select(F.col("p_brand").alias("category")).distinct()
    mapping = brands.where(F.col("category").isin(list(TD.LINEITEM_INCOME))).withColumn("type", F.lit("Income"))
    raw = TD.lineitem_raw_log(spark, sf).select("category")
    return CL.classify_with_table(raw, mapping).groupBy("category", "type").agg(F.count(F.lit(1)).alias("n"))


# --- profile --------------------------------------------------------------------


@register("column_profile")
def q_column_profile(spark, sf):
    return PR.column_profile(TD.read_table(spark, sf, "orders"))


@register("top_values")
def q_top_values(spark, sf):
    return PR.top_values(TD.read_table(spark, sf, "orders"))


@register("top_values_log")
def q_top_values_log(spark, sf):
    """The raw text log: columns of few values, of some thousand, and of nearly as many as rows (counted in full)."""
    return PR.top_values(TD.lineitem_raw_log(spark, sf))


@register("duplicate_rows")
def q_duplicate_rows(spark, sf):
    raw = TD.lineitem_raw_log(spark, sf)
    again = raw.where(F.col("account") == "R")  # whole-row repeats, as the table itself has few
    return PR.duplicate_rows(raw.unionByName(again))


@register("amount_stats")
def q_amount_stats(spark, sf):
    return PR.amount_stats(l2(spark, sf))


@register("amount_stats_by_entity")
def q_amount_stats_by_entity(spark, sf):
    return PR.amount_stats(l1(spark, sf), by=BY)


@register("amount_stats_four_decimals")
def q_amount_stats_four_decimals(spark, sf):
    """Discount amounts have four decimals; per supplier."""
    li = TD.read_table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount")
    amount = F.col("l_extendedprice").cast("decimal(16,2)") * F.col("l_discount").cast("decimal(4,2)")
    return PR.amount_stats(li.select(F.col("l_suppkey").alias("entity_id"), amount.alias("amount")), by=BY)


# --- macro and context ----------------------------------------------------------


@register("macro_yoy")
def q_macro_yoy(spark, sf):
    return MA.macro_indicators(TD.orders_macro_observations(spark, sf), yoy_series=None)


@register("macro_saved_series")
def q_macro_saved_series(spark, sf):
    """The series saved as response bodies, one file a series, and read back."""
    obs = TD.orders_macro_observations(spark, sf)
    body = F.to_json(F.struct(F.first("series_id").alias("series_id"), F.sort_array(F.collect_list(F.struct("date", "value")), asc=False).alias("observations")))
    root = scratch_path(spark, "saved-series")
    obs.groupBy("series_id").agg(body.alias("value")).withColumnRenamed("series_id", "name").write.partitionBy("name").text(root)
    return MA.macro_indicators(SM.read_observations(spark, f"{root}/*"), yoy_series=None)


@register("context_package")
def q_context_package(spark, sf):
    return CX.financial_context(l1(spark, sf), by=BY, plans=plans(spark, sf)).select(*BY, "context_json")


@register("context_package_whole")
def q_context_package_whole(spark, sf):
    return CX.financial_context(l1(spark, sf), FILTER_A, plans=plans(spark, sf).drop("entity_id")).select("context_json")


# --- store operators ------------------------------------------------------------


@register("append_new_rows")
def q_append_new_rows(spark, sf):
    led = l1(spark, sf).select("transaction_id", "year_month", F.col("amount").cast("double").alias("amount"))
    existing = led.where(F.col("year_month") < "1998-01")
    incoming = led.where(F.col("year_month") >= "1997-07")
    # some stored ids come again under another month
    moved = led.where((F.col("year_month") < "1993-01")).withColumn("year_month", F.lit("1999-01"))
    incoming = incoming.unionByName(moved)
    return existing.unionByName(ST.append_new(existing, incoming))


@register("append_batches")
def q_append_batches(spark, sf):
    """A table in files that grows by a large batch (joined) and by a small one (looked up), both with ids that it has."""
    led = l1(spark, sf).select("transaction_id", "year_month", F.col("amount").cast("double").alias("amount"))
    root = scratch_path(spark, "append-batches")
    ST.replace_table(led.where(F.col("year_month") < "1998-01"), root, ["year_month"], key="transaction_id")
    ST.append_table(led.where(F.col("year_month") >= "1997-07"), root, partition_by=["year_month"])
    newest = ST.newest_n(led, 300, ts="year_month", tie=["transaction_id"])
    fresh = newest.withColumn("transaction_id", F.concat("transaction_id", F.lit("-b")))
    ST.append_table(newest.unionByName(fresh), root, partition_by=["year_month"])
    return ST.read_current(spark, root).select(*led.columns)


@register("upsert_by_key")
def q_upsert_by_key(spark, sf):
    led = l1(spark, sf)
    current = S.monthly_summary(led.where(F.col("year_month") < "1999-01"))
    updates = S.monthly_summary(led.where((F.col("year_month") >= "1998-07") & (F.col("account") == "F")))
    return ST.upsert(current, updates, ["year_month"], flag="op")


@register("latest_per_key")
def q_latest_per_key(spark, sf):
    ev = TD.read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return ST.latest_per_key(ev, ["user_id"], ts="ts", tie=["event_id"])


@register("newest_n")
def q_newest_n(spark, sf):
    ev = TD.read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return ST.newest_n(ev, 50, ts="ts", tie=["event_id"])


@register("find_transactions")
def q_find_transactions(spark, sf):
    df = ST.find_rows(l1(spark, sf), {"account": "F", "category": "1-URGENT"})
    return df.select("transaction_id", "year_month", "type", F.col("amount").cast("double").alias("amount"))


@register("variant_payload")
def q_variant_payload(spark, sf):
    ev = ST.with_variant(TD.read_table(spark, sf, "events").select("event_id", "event_type", "props"), ["props"])
    return ev.select("event_id", "event_type", F.variant_get("props", "$.k", "int").alias("k"))


@register("budget_plan_changes")
def q_budget_plan_changes(spark, sf):
    base = TD.customer_budget_plans(spark, sf)
    t0 = F.lit("2025-01-01 00:00:00").cast("timestamp")
    plans_tbl = base.select("budget_id", "category", "monthly_limit", F.lit(None).cast("string").alias("applies_from"),
                            F.lit(None).cast("string").alias("notes"), t0.alias("created_at"),
                            F.lit(None).cast("timestamp").alias("updated_at"))
    cust = TD.read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    key = lambda k: F.concat_ws("-", F.col("c_custkey").cast("string"), F.lit(k))
    t1 = F.lit("2025-02-01 00:00:00").cast("timestamp")
    t2 = F.lit("2025-03-01 00:00:00").cast("timestamp")
    nul = F.lit(None).cast("string")
    deletes = cust.where(F.col("c_acctbal") < 0).select(F.lit("delete").alias("op"), key("d").alias("budget_id"), nul.alias("category"),
                                                       F.lit(None).cast("double").alias("monthly_limit"), nul.alias("applies_from"),
                                                       nul.alias("notes"), t1.alias("changed_at"))
    updates = cust.where(F.col("c_mktsegment") == "BUILDING").select(
        F.lit("update").alias("op"), key("c").alias("budget_id"), nul.alias("category"),
        F.round(F.abs(F.col("c_acctbal")), 2).alias("monthly_limit"), F.lit("2025-03").alias("applies_from"),
        F.lit("raised").alias("notes"), t2.alias("changed_at"))
    creates = cust.where(F.col("c_mktsegment") == "MACHINERY").select(
        F.lit("create").alias("op"), key("e").alias("budget_id"), F.lit("2-HIGH").alias("category"),
        F.lit(250.0).alias("monthly_limit"), nul.alias("applies_from"), nul.alias("notes"), t1.alias("changed_at"))
    out = ST.apply_plan_changes(plans_tbl, deletes.unionByName(updates).unionByName(creates))
    return out.select("budget_id", "category", "monthly_limit", "applies_from", "notes",
                      F.date_format("created_at", "yyyy-MM-dd").alias("created_day"),
                      F.date_format("updated_at", "yyyy-MM-dd").alias("updated_day"))


@register("budget_plan_change_log")
def q_budget_plan_change_log(spark, sf):
    """Plans from a log with many changes a plan, several in one batch: every event of a user is a change of the user's plan.

    A purchase creates, a signup and an error delete, all else updates; what an
    update carries depends on the event, so fields come from different changes.
    """
    ev = TD.read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    op = F.when(F.col("event_type") == "purchase", "create").when(F.col("event_type").isin("signup", "error"), "delete").otherwise("update")
    some = lambda k, c: F.when(F.col("event_id") % k == 0, c)
    log = ev.select(
        op.alias("op"), F.col("user_id").cast("string").alias("budget_id"), some(2, F.col("event_type")).alias("category"),
        some(3, F.col("value")).alias("monthly_limit"), some(5, F.date_format("ts", "yyyy-MM")).alias("applies_from"),
        some(7, F.col("event_id").cast("string")).alias("notes"), F.col("ts").cast("timestamp").alias("changed_at"), "event_id")
    t0 = F.lit("2020-01-01 00:00:00").cast("timestamp")
    had = ev.where(F.col("user_id") % 3 == 0).select(
        F.col("user_id").cast("string").alias("budget_id"), F.lit("old").alias("category"), F.lit(1.0).alias("monthly_limit"),
        F.lit(None).cast("string").alias("applies_from"), F.lit("kept").alias("notes"), t0.alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at")).distinct()
    out = ST.apply_plan_changes(had, log, tie=["event_id"])
    return out.select("budget_id", "category", "monthly_limit", "applies_from", "notes",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


# --- streaming ------------------------------------------------------------------

LEDGER_OUT = ["transaction_id", "transaction_date", "year_month", "category", "type", "account", "entity_id"]


EVENTS_CUT = "2024-01-16 00:00:00"


def _in_arrivals(spark, sf, name: str, start) -> str:
    """Run a stream over the events in three arrivals, one batch each; returns its root.

    Recent events come first; then half of the old ones (late by any watermark)
    with repeats of recent ones; then the other old ones with repeats of both.
    """
    root = scratch_path(spark, name)
    ev = TD.read_table(spark, sf, "events")
    old = F.col("ts") < F.lit(EVENTS_CUT).cast(ev.schema["ts"].dataType)
    even = F.col("event_id") % 2 == 0
    again = F.col("event_id") % 10 == 0
    for arrival in (ev.where(~old), ev.where((old & even) | (~old & again)), ev.where((old & ~even) | again)):
        arrival.write.mode("append").parquet(f"{root}/source")
        stream = TD.events_to_ledger(IN.file_stream(spark, f"{root}/source", ev.schema))
        IN.run_to_completion(lambda stream=stream: start(stream, root))
    return root


SUMMARY_OUT = [*BY, "year_month", "total_income", "total_expense", "net", "transaction_count", "savings_rate_pct"]


@register("stream_append_dedup")
def q_stream_append_dedup(spark, sf):
    root = _in_arrivals(spark, sf, "stream-append", lambda s, r: IN.start_append_dedup(s, f"{r}/table", f"{r}/ck"))
    return spark.read.parquet(f"{root}/table").select(*LEDGER_OUT, F.col("amount").cast("double").alias("amount"))


@register("stream_monthly_summary")
def q_stream_monthly_summary(spark, sf):
    root = _in_arrivals(spark, sf, "stream-summary", lambda s, r: IN.start_monthly_summary(s, f"{r}/table", f"{r}/ck", by=BY))
    return spark.read.parquet(f"{root}/table").select(*SUMMARY_OUT)


@register("stream_ingest_summary")
def q_stream_ingest_summary(spark, sf):
    root = _in_arrivals(spark, sf, "stream-ingest", lambda s, r: IN.start_ingest(s, f"{r}/table", f"{r}/summary", f"{r}/ck", by=BY))
    return spark.read.parquet(f"{root}/summary").select(*SUMMARY_OUT)


# --- jobs -----------------------------------------------------------------------


@register("profile_report")
def q_profile_report(spark, sf):
    raw = TD.lineitem_raw_log(spark, sf)
    clean = CN.clean_transactions(raw, source="lineitem", mapping=TD.LINEITEM_MAPPING)
    return PF.profiling_summary(raw, clean).select("source_rows", "clean_rows", "rows_dropped_in_transform",
                                                   "duplicate_rows", "columns_json")


@register("profile_report_json")
def q_profile_report_json(spark, sf):
    raw = TD.lineitem_raw_log(spark, sf)
    clean = CN.clean_transactions(raw, source="lineitem", mapping=TD.LINEITEM_MAPPING)
    return PF.profile_report(raw, clean)


@register("sql_passthrough")
def q_sql_passthrough(spark, sf):
    ST.register(l2(spark, sf), "transactions")
    return ST.run_query(spark, """
        SELECT category, type, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
        FROM transactions WHERE year_month = ? AND type = ?
        GROUP BY category, type""", ["1998-03", "Expense"])


@register("top_anomalies")
def q_top_anomalies(spark, sf):
    return AN.top_anomalies(l2(spark, sf), 15)


@register("category_breakdown_by_entity")
def q_category_breakdown_by_entity(spark, sf):
    return S.category_breakdown(l1(spark, sf), by=BY)


@register("account_breakdown_by_entity")
def q_account_breakdown_by_entity(spark, sf):
    return S.account_breakdown(l2(spark, sf), by=BY)


@register("date_range_by_entity")
def q_date_range_by_entity(spark, sf):
    return S.date_range(l3(spark, sf), by=BY)


@register("context_package_fields")
def q_context_package_fields(spark, sf):
    """Fields read back out of each entity's JSON document (checks the document against the oracle)."""
    ctx = CX.financial_context(l1(spark, sf), by=BY, plans=plans(spark, sf))
    j = F.col("context_json")

    def get(path, t):
        return F.get_json_object(j, path).cast(t)

    return ctx.select(
        *BY,
        get("$.overview.months_covered", "bigint").alias("months_covered"),
        get("$.overview.totals.total_income", "double").alias("total_income"),
        get("$.overview.totals.net", "double").alias("net"),
        F.json_array_length(F.get_json_object(j, "$.monthly_summary")).alias("n_months_listed"),
        get("$.top_expense_categories[0].category", "string").alias("top_expense_category"),
        get("$.financial_health_score.composite_score", "double").alias("composite_score"),
        get("$.financial_health_score.band", "string").alias("band"),
        get("$.budget_overrun.total_over_budget_amount", "double").alias("total_over_budget_amount"),
    )


@register("category_breakdown_ordered")
def q_category_breakdown_ordered(spark, sf):
    """The breakdown with the place of each row in the order of the source."""
    order = [F.col("total_amount").desc(), "category", "type"]
    placed = global_rank(S.category_breakdown(l1(spark, sf)), order, "place")
    return placed.withColumn("place", (F.col("place") - 1).cast("long"))


@register("whatif_context_fields")
def q_whatif_context_fields(spark, sf):
    ctx = CX.whatif_context(l1(spark, sf), WHATIF_SCENARIOS, by=BY)
    j = F.col("context_json")
    get = lambda path, t: F.get_json_object(j, path).cast(t)
    return ctx.select(
        *BY, "scenario_id",
        get("$.scenario.name", "string").alias("scenario"),
        get("$.whatif_results.adjusted_net_monthly", "double").alias("adjusted_net_monthly"),
        get("$.whatif_results.adjusted_cumulative_net", "double").alias("adjusted_cumulative_net"),
        get("$.baseline.months_covered", "bigint").alias("months_covered"),
        get("$.baseline.totals.net", "double").alias("net"),
        get("$.top_expense_categories[0].category", "string").alias("top_expense_category"),
        get("$.financial_health_score.composite_score", "double").alias("composite_score"),
    )


@register("fire_context_fields")
def q_fire_context_fields(spark, sf):
    ctx = CX.fire_context(fire_inputs(spark, sf), by=BY)
    j = F.col("context_json")
    get = lambda path, t: F.get_json_object(j, path).cast(t)
    return ctx.select(
        *BY,
        get("$.fire_inputs.monthly_income", "double").alias("monthly_income"),
        get("$.fire_results.fire_number", "double").alias("fire_number"),
        get("$.fire_results.fire_age", "double").alias("fire_age"),
        get("$.return_scenarios[1].fire_age", "double").alias("base_fire_age"),
        get("$.withdrawal_scenarios[1].fire_number", "double").alias("number_at_4_pct"),
    )


# --- star schema ------------------------------------------------------------------


@register("dim_category")
def q_dim_category(spark, sf):
    return MT.dim_category(l2(spark, sf))


@register("category_month_mart")
def q_category_month_mart(spark, sf):
    return MT.category_month_mart(l1(spark, sf))


@register("source_fallback")
def q_source_fallback(spark, sf):
    """The operational store (an empty, never-written table) is skipped; the ledger derived from orders is used."""
    store_root = scratch_path(spark, "operational-store")

    def operational():
        cur = ST.read_current(spark, store_root)
        if cur is None:
            raise FileNotFoundError(store_root)
        return cur

    def empty_store():
        return l1(spark, sf).where(F.lit(False))

    ledger = ST.first_non_empty([operational, empty_store, lambda: l1(spark, sf)])
    return S.monthly_summary(ledger)


@register("context_package_whole_fields")
def q_context_package_whole_fields(spark, sf):
    """Fields read back from the whole-ledger (filtered) document."""
    ctx = CX.financial_context(l1(spark, sf), FILTER_A, plans=plans(spark, sf).drop("entity_id"))
    j = F.col("context_json")

    def get(path, t):
        return F.get_json_object(j, path).cast(t)

    return ctx.select(
        get("$.period.start", "string").alias("period_start"),
        get("$.overview.months_covered", "bigint").alias("months_covered"),
        get("$.overview.totals.total_expense", "double").alias("total_expense"),
        get("$.overview.savings_rate_pct", "double").alias("savings_rate_pct"),
        F.json_array_length(F.get_json_object(j, "$.monthly_trends")).alias("n_trend_months"),
        get("$.monthly_trends[35].expense_3mo_avg", "double").alias("last_expense_3mo_avg"),
        get("$.top_income_categories[0].category", "string").alias("top_income_category"),
        get("$.account_breakdown[0].account", "string").alias("first_account"),
        get("$.financial_health_score.category_hhi", "double").alias("category_hhi"),
        get("$.budget_overrun.n_over_budget", "bigint").alias("n_over_budget"),
    )

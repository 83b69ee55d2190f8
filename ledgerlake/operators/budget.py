"""Budget versus actual.

The largest limit per category (plans may repeat a category) is compared with
the actual expense of the selected period: ``over_under = actual - limit``;
missing actual is 0; a category with spend but no plan is absent. As in the
source, the monthly limit is not multiplied by the number of months and
``applies_from``/``period`` are not applied.

Both sides are aggregated by (by, category) before the left join, so the join
sees one row per key on each side and needs no further exchange.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_dec
from ..functions.filters import apply_filter
from ..functions.ranking import global_rank
from .summary import EXPENSE


def plan_limits(plans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Max monthly_limit per (by, category) (A10)."""
    return plans.groupBy(*by, "category").agg(F.max("monthly_limit").alias("monthly_limit"))


def _compare(ledger: DataFrame, plans: DataFrame, filters, by: Sequence[str]) -> DataFrame:
    limits = plan_limits(plans, by)
    actual = (
        apply_filter(ledger, filters)
        .where(F.col("type") == EXPENSE)
        .groupBy(*by, "category")
        .agg(F.sum("amount").alias("_actual"))
    )
    cmp = limits.join(actual, [*by, "category"], "left")
    act = F.coalesce(F.col("_actual"), F.lit(0).cast("decimal(18,2)"))
    # exact overrun: decimal actual minus the limit as decimal(28,8)
    return cmp.select(
        *by, "category", "monthly_limit", act.alias("_act"),
        (act - F.col("monthly_limit").cast("decimal(28,8)")).alias("_over"),
    )


def budget_status(ledger: DataFrame, plans: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Per planned category: monthly_limit, actual, over_under (rounded 2), is_over, over_rank.

    ``over_rank`` orders the over-budget categories by overrun, largest first
    (the over-budget list of the source); it is null for the others. Without
    ``by`` the ranks are those of the whole table (``functions.ranking``), found when called.
    """
    out = _compare(ledger, plans, filters, by)
    order = [F.col("_over").desc(), F.col("category").asc()]
    if by:
        ranked = out.withColumn("over_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        ranked = global_rank(out, order, "over_rank")
    ranked = ranked.withColumn("over_rank", F.when(F.col("_over") > 0, F.col("over_rank")))
    return ranked.select(
        *by, "category",
        round_dec("monthly_limit", 2).alias("monthly_limit"),
        round_dec(F.col("_act").cast("double"), 2).alias("actual"),
        round_dec(F.col("_over").cast("double"), 2).alias("over_under"),
        (F.col("_over") > 0).alias("is_over"),
        "over_rank",
    )


def over_budget_total(ledger: DataFrame, plans: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: total of positive overruns (exact, rounded 2) and counts of over-budget / planned categories."""
    out = _compare(ledger, plans, filters, by)
    pos = F.when(F.col("_over") > 0, F.col("_over"))
    return out.groupBy(*by).agg(
        round_dec(F.coalesce(F.sum(pos).cast("double"), F.lit(0.0)), 2).alias("total_over_budget_amount"),
        F.count(pos).alias("n_over_budget"),
        F.count(F.lit(1)).alias("n_planned"),
    )

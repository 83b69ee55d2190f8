"""Month-over-month trends and rolling figures.

Windows step over months that are present (a month without rows is skipped,
not zero-filled), and the filter applies before the window, so the first month
shown has a null change. The window input is the (by, month) aggregate, never
raw rows: with ``by=()`` it is one partition of at most a few hundred months;
with entity keys it is partitioned by the keys, each group bounded by its
number of months however skewed the raw rows are.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pct_change, round_dec
from ..functions.filters import apply_filter
from .summary import EXPENSE, expense_amt, income_amt, n_rows


def _monthly_decimal(ledger: DataFrame, filters, by: Sequence[str]) -> DataFrame:
    df = apply_filter(ledger, filters)
    return df.groupBy(*by, "year_month").agg(
        F.sum(income_amt()).alias("_inc"), F.sum(expense_amt()).alias("_exp")
    )


def monthly_trends(ledger: DataFrame, filters=None, by: Sequence[str] = (), rolling: Sequence[int] = (3,),
                   running: bool = False) -> DataFrame:
    """income, expense, net = income - expense, MoM % changes, rolling expense averages.

    ``rolling`` lists the window lengths in months (the source has 3 only);
    ``running=True`` adds cumulative income, expense and net.
    """
    return trends_from_monthly(_monthly_decimal(ledger, filters, by), by, rolling, running)


def trends_from_monthly(m: DataFrame, by: Sequence[str] = (), rolling: Sequence[int] = (3,),
                        running: bool = False) -> DataFrame:
    """Trends from a (by, year_month, _inc, _exp) aggregate with exact decimal sums."""
    w = Window.partitionBy(*by).orderBy("year_month")
    cols = [
        *by,
        "year_month",
        F.col("_inc").cast("double").alias("total_income"),
        F.col("_exp").cast("double").alias("total_expense"),
        (F.col("_inc") - F.col("_exp")).cast("double").alias("net"),
        pct_change(F.col("_exp").cast("double"), F.lag(F.col("_exp").cast("double")).over(w)).alias("expense_mom_change_pct"),
        pct_change(F.col("_inc").cast("double"), F.lag(F.col("_inc").cast("double")).over(w)).alias("income_mom_change_pct"),
    ]
    for k in rolling:
        wf = w.rowsBetween(-(k - 1), Window.currentRow)
        avg = F.sum("_exp").over(wf).cast("double") / F.count(F.lit(1)).over(wf)
        cols.append(round_dec(avg, 2).alias(f"expense_{k}mo_avg"))
    if running:
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cols += [
            F.sum("_inc").over(wr).cast("double").alias("running_income"),
            F.sum("_exp").over(wr).cast("double").alias("running_expense"),
            F.sum(F.col("_inc") - F.col("_exp")).over(wr).cast("double").alias("running_net"),
        ]
    return m.select(*cols)


def category_share(ledger: DataFrame, filters=None, by: Sequence[str] = (), type_filter: str = EXPENSE) -> DataFrame:
    """Each category's percent of the total of one type (D3): over a window per ``by``, or against one total of the ledger."""
    df = apply_filter(ledger, filters).where(F.col("type") == type_filter)
    g = df.groupBy(*by, "category").agg(F.sum("amount").alias("_t"))
    total = F.sum("_t").over(Window.partitionBy(*by)) if by else df.agg(F.sum("amount")).scalar()
    return g.select(
        *by,
        "category",
        F.col("_t").cast("double").alias("total_amount"),
        round_dec(F.try_divide(F.col("_t").cast("double") * F.lit(100.0), F.nullif(total.cast("double"), F.lit(0.0))), 2)
        .alias("share_pct"),
    )


def yearly_trends(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Yearly income/expense/net with year-over-year change (D4 trend mart)."""
    df = apply_filter(ledger, filters)
    g = df.groupBy(*by, "year").agg(F.sum(income_amt()).alias("_inc"), F.sum(expense_amt()).alias("_exp"),
                                    n_rows(df).alias("transaction_count"))
    w = Window.partitionBy(*by).orderBy("year")
    exp = F.col("_exp").cast("double")
    return g.select(
        *by,
        "year",
        F.col("_inc").cast("double").alias("total_income"),
        exp.alias("total_expense"),
        (F.col("_inc") - F.col("_exp")).cast("double").alias("net"),
        "transaction_count",
        pct_change(exp, F.lag(exp).over(w)).alias("expense_yoy_change_pct"),
    )

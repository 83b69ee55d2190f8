"""Ledger aggregates.

Every function takes a canonical ledger DataFrame, an optional filter spec and
``by``: entity key columns. With ``by=()`` the answer is the single-ledger one
of the source application; with keys, one job answers it for every entity.

Money is summed as ``decimal(18,2)`` (exact, order-free) and cast to double on
output; averages are ``sum / count``. Map-side partial aggregation happens
before every shuffle, so a hot key costs one row per map task, not its rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dsum, round_dec
from ..functions.filters import LedgerFilter, apply_filter

INCOME = "Income"
EXPENSE = "Expense"


def _amt() -> Column:
    return F.col("amount")


def income_amt() -> Column:
    return F.when(F.col("type") == INCOME, _amt()).otherwise(F.lit(0))


def expense_amt() -> Column:
    return F.when(F.col("type") == EXPENSE, _amt()).otherwise(F.lit(0))


def signed_amt() -> Column:
    """Income counts +, every other type - (the monthly-summary definition of net)."""
    return F.when(F.col("type") == INCOME, _amt()).otherwise(-_amt())


WEIGHT = "_n"


def n_rows(df: DataFrame) -> Column:
    """Number of transactions: ``count(*)``, or the sum of the weight column of a pre-aggregated ledger."""
    return F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))


def preaggregate(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """The ledger summed per (by, year_month, category, type, account) with a row-count weight ``_n``.

    Every aggregate of this module (and trends, anomalies, health, budget)
    gives the same answer on it as on the raw ledger. Several analytics built
    on one pre-aggregate inside one query share its scan and shuffle (Spark
    reuses the identical exchange), so the raw rows are read once.
    """
    df = apply_filter(ledger, filters)
    return df.groupBy(*by, "year_month", "category", "type", "account").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias(WEIGHT)
    )


def savings_rate(net, income) -> Column:
    """round(net / income * 100, 2) when income > 0, else null (A2)."""
    net = F.col(net) if isinstance(net, str) else net
    income = F.col(income) if isinstance(income, str) else income
    return F.when(income > 0, round_dec(net / income * F.lit(100.0), 2))


def monthly_summary(ledger: DataFrame, filters=None, by: Sequence[str] = (), stamp: bool = False,
                    ordered: bool = False) -> DataFrame:
    """Per (by, year_month): total_income, total_expense, net, transaction_count, savings_rate_pct (A1, A2).

    ``ordered`` sorts as the source lists it (K1): oldest month first.
    """
    df = apply_filter(ledger, filters)
    out = (
        df.groupBy(*by, "year_month")
        .agg(
            dsum(income_amt()).alias("total_income"),
            dsum(expense_amt()).alias("total_expense"),
            dsum(signed_amt()).alias("net"),
            n_rows(df).alias("transaction_count"),
        )
        .withColumn("savings_rate_pct", savings_rate("net", "total_income"))
    )
    if stamp:
        out = out.withColumn("generated_at", F.current_timestamp())
    return read_summary(out, by) if ordered else out


def category_breakdown(ledger: DataFrame, filters=None, by: Sequence[str] = (), year_month: str | None = None,
                       type_filter: str | None = None, ordered: bool = False) -> DataFrame:
    """Per (by, category, type): total_amount, transaction_count, avg_amount (A3).

    ``ordered`` sorts by total, largest first (K1; ties by category and type).
    """
    spec = LedgerFilter.of(filters)
    if year_month or type_filter:
        from dataclasses import replace

        spec = replace(spec, year_month=year_month or spec.year_month, type=type_filter or spec.type)
    df = apply_filter(ledger, spec)
    g = df.groupBy(*by, "category", "type").agg(F.sum(_amt()).alias("_s"), n_rows(df).alias("transaction_count"))
    out = g.select(
        *by,
        "category",
        "type",
        F.col("_s").cast("double").alias("total_amount"),
        "transaction_count",
        (F.col("_s").cast("double") / F.col("transaction_count")).alias("avg_amount"),
    )
    return out.orderBy(*by, F.col("total_amount").desc(), "category", "type") if ordered else out


def top_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows overall (``by=()``) or per ``by`` group.

    Overall: ORDER BY .. LIMIT, planned as TakeOrderedAndProject (per-partition
    top-n, then a merge of n rows per partition). Per group: ``row_number() <= n``,
    which Spark plans with a partial WindowGroupLimit before the shuffle, so a
    group holding a third of the rows still sends only n rows per map task.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_categories(ledger: DataFrame, n: int = 5, type_filter: str = EXPENSE, filters=None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Per category of one type: total_amount, transaction_count; top n by total (A4, K2).

    As in the source, ``type_filter`` replaces any ``types`` of the filter spec.
    Ties are broken by category so that the limit is deterministic.
    """
    spec = LedgerFilter.of(filters).with_types([type_filter])
    df = apply_filter(ledger, spec)
    g = df.groupBy(*by, "category").agg(dsum(_amt()).alias("total_amount"), n_rows(df).alias("transaction_count"))
    return top_n(g, n, [F.col("total_amount").desc(), F.col("category").asc()], by)


def account_breakdown(ledger: DataFrame, filters=None, by: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Per account: total_expense, total_income, transaction_count (A5); ``ordered`` by expense, largest first (K1)."""
    df = apply_filter(ledger, filters)
    out = df.groupBy(*by, "account").agg(
        dsum(expense_amt()).alias("total_expense"),
        dsum(income_amt()).alias("total_income"),
        n_rows(df).alias("transaction_count"),
    )
    return out.orderBy(*by, F.col("total_expense").desc(), "account") if ordered else out


def date_range(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """min/max transaction_date and row count."""
    df = apply_filter(ledger, filters)
    return df.groupBy(*by).agg(
        F.min("transaction_date").alias("min_date"),
        F.max("transaction_date").alias("max_date"),
        F.count(F.lit(1)).alias("row_count"),
    )


def type_totals(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Per type: total_amount, n."""
    df = apply_filter(ledger, filters)
    return df.groupBy(*by, "type").agg(dsum(_amt()).alias("total_amount"), n_rows(df).alias("n"))


def filter_values(ledger: DataFrame) -> DataFrame:
    """Distinct months, accounts and categories as (field, value) rows.

    One scan and one shuffle for all three: each row emits three (field, value)
    pairs, de-duplicated with a map-side partial aggregate.
    """
    pairs = F.array(
        F.struct(F.lit("year_month").alias("field"), F.col("year_month").alias("value")),
        F.struct(F.lit("account").alias("field"), F.col("account").alias("value")),
        F.struct(F.lit("category").alias("field"), F.col("category").alias("value")),
    )
    return ledger.select(F.inline(pairs)).distinct()


def distinct_values(ledger: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column."""
    return ledger.select(column).distinct().orderBy(column)


def filtered_transactions(ledger: DataFrame, filters=None, limit: int | None = 500) -> DataFrame:
    """Full rows, newest date first, optional limit (F3). Ties: transaction_id ascending."""
    df = apply_filter(ledger, filters).orderBy(F.col("transaction_date").desc(), F.col("transaction_id").asc())
    return df.limit(limit) if limit else df


def kpi_totals(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Dashboard KPIs (A9): totals, overall savings rate, transaction count, months covered.

    Computed from the ledger in one aggregate; ``count_distinct(year_month)`` is
    the number of monthly-summary rows. Totals are exact decimal sums.
    """
    df = apply_filter(ledger, filters)
    g = df.groupBy(*by).agg(
        F.sum(income_amt()).alias("_inc"),
        F.sum(expense_amt()).alias("_exp"),
        F.sum(signed_amt()).alias("_net"),
        n_rows(df).alias("transaction_count"),
        F.count_distinct("year_month").alias("months_covered"),
    )
    inc, net = F.col("_inc").cast("double"), F.col("_net").cast("double")
    return g.select(
        *by,
        inc.alias("total_income"),
        F.col("_exp").cast("double").alias("total_expense"),
        net.alias("net"),
        savings_rate(net, inc).alias("savings_rate_pct"),
        "transaction_count",
        "months_covered",
    )


def read_summary(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The monthly summary, oldest month first."""
    return summary.orderBy(*by, "year_month")


def recent_months(summary: DataFrame, n: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Latest n months of a monthly summary, newest first."""
    cols = [c for c in ["year_month", "total_income", "total_expense", "net", "savings_rate_pct", "transaction_count"]]
    return top_n(summary.select(*by, *cols), n, [F.col("year_month").desc()], by)

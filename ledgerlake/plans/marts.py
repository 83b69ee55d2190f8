"""Star schema over the canonical ledger (design-doc item D4).

Dimensions are the distinct values of the descriptive columns (one
partially-aggregated ``distinct`` each); the fact table keeps the keys and the
measure. The yearly trend mart is ``operators.trends.yearly_trends``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_month(ledger: DataFrame) -> DataFrame:
    return ledger.select("year_month", "year", "month").distinct()


def dim_category(ledger: DataFrame) -> DataFrame:
    return ledger.select("category", "type").distinct()


def dim_account(ledger: DataFrame) -> DataFrame:
    return ledger.select("account").distinct()


def fact_transactions(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ledger.select("transaction_id", *by, "year_month", "category", "type", "account", "amount")


def star_schema(ledger: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    return {
        "dim_month": dim_month(ledger),
        "dim_category": dim_category(ledger),
        "dim_account": dim_account(ledger),
        "fact_transactions": fact_transactions(ledger, by),
    }


def category_month_mart(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per (month, type). The category dimension is keyed by (category, type), which the
    fact carries, so its type is read from the fact and no join can multiply rows."""
    return fact_transactions(ledger, by).groupBy(*by, "year_month", "type").agg(
        F.sum("amount").cast("double").alias("total_amount"), F.count(F.lit(1)).alias("transaction_count"))

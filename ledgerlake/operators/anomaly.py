"""Spending anomalies by z-score.

Expense totals per (category, month); sample mean and standard deviation per
category over the months present; rows with |z| >= threshold are kept, z tested
unrounded and shown rounded to 2. The source joins the per-category stats back
to the per-month totals; here they are window aggregates over the same
(category, month) aggregate, which needs one exchange instead of two plus a join.
The statistics come from exact decimal moments, so the kept set does not depend
on row order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_dec
from ..functions.filters import apply_filter
from ..functions.stats import mean_from, stddev_samp_from, sum_sq
from .summary import EXPENSE


def _scored(ledger: DataFrame, z_threshold: float, by: Sequence[str], filters) -> DataFrame:
    df = apply_filter(ledger, filters).where(F.col("type") == EXPENSE)
    cm = df.groupBy(*by, "category", "year_month").agg(F.sum("amount").alias("_t"))
    w = Window.partitionBy(*by, "category")
    n = F.count(F.lit(1)).over(w)
    s1 = F.sum("_t").over(w)
    s2 = sum_sq("_t", w)
    wide = F.stddev_samp(F.col("_t").cast("double")).over(w)
    st = cm.select(
        *by, "category", "year_month", "_t",
        mean_from(n, s1).alias("_mean"),
        stddev_samp_from(n, s1, s2, wide).alias("_std"),
    )
    t = F.col("_t").cast("double")
    z = (t - F.col("_mean")) / F.col("_std")
    kept = st.where(F.col("_std").isNotNull() & (F.col("_std") > 0)).withColumn("_z", z).where(
        F.abs(F.col("_z")) >= F.lit(float(z_threshold))
    )
    return kept.select(
        *by,
        "category",
        "year_month",
        round_dec(t, 2).alias("month_total"),
        round_dec("_mean", 2).alias("category_mean"),
        round_dec("_std", 2).alias("category_std"),
        round_dec("_z", 2).alias("z_score"),
        "_z",
    )


def detect_anomalies(ledger: DataFrame, z_threshold: float = 2.0, by: Sequence[str] = (), filters=None,
                     ordered: bool = False) -> DataFrame:
    """Anomalous (category, month) totals; ``ordered`` sorts by |z| descending as the source lists them."""
    out = _scored(ledger, z_threshold, by, filters)
    if ordered:
        out = out.orderBy(F.abs("_z").desc(), *by, "category", "year_month")
    return out.drop("_z")


def top_anomalies(ledger: DataFrame, n: int = 15, z_threshold: float = 2.0, filters=None) -> DataFrame:
    """First n anomalies by unrounded |z| descending, with their rank (the page shows 15)."""
    top = _scored(ledger, z_threshold, (), filters).orderBy(F.abs("_z").desc(), "category", "year_month").limit(n)
    cols = [c for c in top.columns if c != "_z"]
    listed = top.agg(F.sort_array(F.collect_list(F.struct(
        (-F.abs("_z")).alias("_less"), "category", "year_month", *[c for c in cols if c not in ("category", "year_month")]))).alias("_l"))  # n items
    return listed.select(F.posexplode("_l").alias("_place", "_r")).select(
        *[F.col(f"_r.{c}").alias(c) for c in cols], (F.col("_place") + 1).alias("rank"))

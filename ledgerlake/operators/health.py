"""Financial health score.

Four sub-scores, each clipped to [0, 100]:

* savings rate: ``rate / 50 * 100`` with rate = net / income * 100 (0 when income <= 0);
* expense and income stability: ``100 - CV * 100`` with CV = population std /
  mean of the monthly totals (0 for one month or a zero mean);
* diversification: ``(1 - HHI) * 100`` over expense categories (0 without expense).

Weights .40 / .25 / .15 / .20. The display form weights the unrounded
sub-scores; the snapshot form rounds each to one decimal first.

Plan: one scan of the ledger grouped by two grouping sets, (by, month) and
(by, expense category), then one second-level aggregate by ``by`` that reads
each set's rows. No join. Rows of other types share one group of the second
set, since no score reads their categories. With keys, the ledger's few needed
columns are first dealt by key: an entity has few rows per month in any one
scan task, so an aggregate before that shuffle would hold and send about one
row for each that it reads. The hint lets AQE split the partition of a hot
key; each part then sends one row per month and category. All moments are
exact decimal sums (``functions.stats``), added up over ledger rows as pairs
of longs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, round_dec, safe_div
from ..functions.filters import apply_filter
from ..functions.stats import from_halves, halves, has_halves, stddev_pop_from, sum_sq
from .summary import EXPENSE, INCOME, WEIGHT

# Sub-score weights and band thresholds of the health score.
WEIGHTS = {
    "savings_score": 0.40,
    "expense_stability_score": 0.25,
    "income_stability_score": 0.15,
    "diversification_score": 0.20,
}
BANDS = ((75.0, "Healthy"), (50.0, "Fair"))
LOWEST_BAND = "At Risk"


def band_expr(score: Column) -> Column:
    e = F.lit(LOWEST_BAND)
    for lo, name in reversed(BANDS):
        e = F.when(score >= F.lit(lo), F.lit(name)).otherwise(e)
    return e


def health_inputs(ledger: DataFrame, filters=None, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: exact income/expense/net totals, monthly moments and expense-category moments."""
    money = ledger.schema["amount"].dataType
    is_income, is_expense = (F.coalesce(F.col("type") == t, F.lit(False)) for t in (INCOME, EXPENSE))
    df = apply_filter(ledger, filters).withColumns({
        "_is_inc": is_income,
        "_is_exp": is_expense,
        "_exp_cat": F.when(is_expense, F.col("category")),
    })
    if has_halves(money):
        hi, lo = halves("amount", money)
        df = df.withColumns({"_hi": hi, "_lo": lo})
        parts = ("_hi", "_lo")
    else:
        parts = ("amount",)
    if by and WEIGHT not in ledger.columns:  # a pre-aggregate has one row per cell of an entity already
        df = df.select(*by, "year_month", "_exp_cat", "_is_inc", "_is_exp", *parts).hint("rebalance", *by)
    sums = {
        "_inc": lambda c: F.when(F.col("_is_inc"), c).otherwise(F.lit(0)),
        "_exp": lambda c: F.when(F.col("_is_exp"), c).otherwise(F.lit(0)),
        "_net": lambda c: F.when(F.col("_is_inc"), c).otherwise(-c),
    }
    gs = df.groupingSets([[*by, "year_month"], [*by, "_exp_cat", "_is_exp"]], *by, "year_month", "_exp_cat", "_is_exp").agg(
        *[F.sum(of(F.col(p))).alias(name + p) for name, of in sums.items() for p in parts],
        F.grouping("year_month").alias("_is_cat"),
    )
    whole = lambda name: from_halves(name + "_hi", name + "_lo", money) if len(parts) == 2 else F.col(name + "amount")
    gs = gs.select(*by, "_is_exp", "_is_cat", *[whole(name).alias(name) for name in sums])
    is_month = F.col("_is_cat") == 0
    is_exp_cat = (F.col("_is_cat") == 1) & F.col("_is_exp")

    def msum(c):
        return F.sum(F.when(is_month, c))

    return gs.groupBy(*by).agg(
        msum(F.col("_inc")).alias("s_inc"),
        msum(F.col("_exp")).alias("s_exp"),
        msum(F.col("_net")).alias("s_net"),
        F.count(F.when(is_month, F.lit(1))).alias("n_months"),
        sum_sq(F.when(is_month, F.col("_inc"))).alias("s2_inc"),
        sum_sq(F.when(is_month, F.col("_exp"))).alias("s2_exp"),
        F.stddev_pop(F.when(is_month, F.col("_inc").cast("double"))).alias("w_inc"),
        F.stddev_pop(F.when(is_month, F.col("_exp").cast("double"))).alias("w_exp"),
        F.sum(F.when(is_exp_cat, F.col("_exp"))).alias("t1"),
        sum_sq(F.when(is_exp_cat, F.col("_exp"))).alias("t2"),
        F.sum(F.when(is_exp_cat, F.col("_exp").cast("double") * F.col("_exp").cast("double"))).alias("w2"),
        F.count(F.when(is_exp_cat, F.lit(1))).alias("n_exp_cats"),
    )


def _stability(n, s1, s2, wide) -> Column:
    mean = safe_div(F.col(s1).cast("double"), F.col(n))
    std = F.when(F.col(n) > 1, stddev_pop_from(n, s1, s2, wide)).otherwise(F.lit(0.0))
    cv = F.coalesce(F.when(mean != 0, std / mean), F.lit(0.0))
    return clip(F.lit(100.0) - cv * F.lit(100.0))


def health_score(ledger: DataFrame, filters=None, by: Sequence[str] = (), snapshot: bool = False) -> DataFrame:
    """Health score per ``by`` group; ``snapshot=True`` gives the rounded-sub-score form.

    A ledger without rows (after the filters) has no score: no row is returned.
    """
    h = health_inputs(ledger, filters, by).where(F.col("n_months") > 0)
    inc = F.col("s_inc").cast("double")
    net = F.col("s_net").cast("double")
    rate = F.when(inc > 0, net / inc * F.lit(100.0)).otherwise(F.lit(0.0))
    t1 = F.col("t1").cast("double")
    has_exp = (F.col("n_exp_cats") > 0) & (t1 > 0)
    hhi = F.when(has_exp, F.coalesce(F.col("t2").cast("double"), F.col("w2")) / (t1 * t1))
    subs = {
        "savings_score": clip(rate / F.lit(50.0) * F.lit(100.0)),
        "expense_stability_score": _stability("n_months", "s_exp", "s2_exp", "w_exp"),
        "income_stability_score": _stability("n_months", "s_inc", "s2_inc", "w_inc"),
        "diversification_score": F.when(has_exp, clip((F.lit(1.0) - hhi) * F.lit(100.0))).otherwise(F.lit(0.0)),
    }
    if snapshot:
        subs = {k: round_dec(v, 1) for k, v in subs.items()}
    scored = h.select(
        *by,
        inc.alias("total_income"),
        F.col("s_exp").cast("double").alias("total_expense"),
        net.alias("net"),
        round_dec(rate, 2).alias("overall_savings_rate_pct"),
        hhi.alias("_hhi"),
        *[v.alias(k) for k, v in subs.items()],
    )
    composite = None
    for k, w in WEIGHTS.items():
        term = F.lit(w) * F.col(k)
        composite = term if composite is None else composite + term
    scored = scored.withColumn("_composite", composite)
    return scored.select(
        *by,
        "total_income",
        "total_expense",
        "net",
        "overall_savings_rate_pct",
        *WEIGHTS.keys(),
        (round_dec("_composite", 1) if snapshot else F.col("_composite")).alias("composite_score"),
        band_expr(F.col("_composite")).alias("band"),
        round_dec("_hhi", 3).alias("category_hhi"),
    )

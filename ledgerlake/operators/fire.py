"""FIRE (financial independence) planner per entity.

FIRE number = monthly expense x 12 x 25 (or annual expense / withdrawal rate).
Contribution = max(income - expense, 0); monthly return r = (1 + R/100)^(1/12) - 1.
Balance after m months: B(m) = S g^m + c (g^m - 1) / r with g = 1 + r
(B(m) = S + c m when r = 0). FIRE month = first m in [0, 12 (target - current age)]
with B(m) >= number (number > 0), tested before the month's growth.

The first month is found in O(1) per entity: the closed-form candidate
ceil(log((N + c/r) / (S + c/r)) / log g) (or ceil((N - S) / c) when r = 0) is
checked together with its two neighbours against B, so rounding of the log
cannot shift the answer. No per-month rows are generated except by
``fire_projection``, whose output is that series.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_or, round_dec
from ..functions.filters import apply_filter
from .summary import expense_amt, income_amt

# Planner defaults of the source.
FIRE_DEFAULTS = {
    "current_savings": 0.0,
    "annual_return_pct": 7.0,
    "withdrawal_rate_pct": 4.0,
    "current_age": 30,
    "target_age": 50,
}
# Return deltas (percentage points) and withdrawal rates of the scenario tables.
RETURN_DELTAS = (("Conservative (-2pp)", -2.0), ("Base case", 0.0), ("Aggressive (+2pp)", 2.0))
WITHDRAWAL_RATES = (3.0, 4.0, 5.0)
DEFAULT_WITHDRAWAL = 4.0


# Integer powers g^m are built from g, g^2, g^4, ... by multiplication only
# (exponentiation by squaring). IEEE products are reproducible in every engine,
# whereas libm ``pow`` differs in the last bit between the JVM and C libraries.
POW_BITS = 11  # exponents below 2048 months; beyond, the library's pow takes over


def monthly_return(annual_pct, compounding: str = "effective") -> Column:
    """Monthly rate from an annual percentage.

    ``effective`` (the planner's rule): (1 + R/100)^(1/12) - 1; ``nominal``: R/100/12.
    """
    if compounding == "nominal":
        return col_or(annual_pct) / F.lit(1200.0)
    return F.pow(F.lit(1.0) + col_or(annual_pct) / F.lit(100.0), F.lit(1.0 / 12.0)) - F.lit(1.0)


def real_return_pct(nominal_pct, inflation_pct) -> Column:
    """Inflation-adjusted annual return in percent: ((1 + R) / (1 + i) - 1) * 100."""
    return ((F.lit(1.0) + col_or(nominal_pct) / F.lit(100.0)) / (F.lit(1.0) + col_or(inflation_pct) / F.lit(100.0))
            - F.lit(1.0)) * F.lit(100.0)


def rate(annual_pct, compounding: str = "effective", inflation_pct: float | str | None = None) -> Column:
    """Monthly rate of an annual return, inflation-adjusted where an inflation (percent, or a column of it) is given."""
    inflation = F.lit(float(inflation_pct)) if isinstance(inflation_pct, (int, float)) else inflation_pct
    return monthly_return(annual_pct if inflation is None else real_return_pct(annual_pct, inflation), compounding)


def with_powers(df: DataFrame, base, prefix: str = "_g") -> DataFrame:
    """Add columns prefix0..prefix{POW_BITS-1} = base^(2^i); one projection per step (no tree blow-up)."""
    df = df.withColumn(f"{prefix}0", col_or(base))
    for i in range(1, POW_BITS):
        df = df.withColumn(f"{prefix}{i}", F.col(f"{prefix}{i - 1}") * F.col(f"{prefix}{i - 1}"))
    return df


def int_pow(m, prefix: str = "_g") -> Column:
    """base^m for m >= 0 from the power columns added by ``with_powers`` (``pow`` from 2^POW_BITS on)."""
    m = col_or(m).cast("long")
    acc = F.lit(1.0)
    for i in range(POW_BITS):
        acc = acc * F.when(F.shiftright(m, i).bitwiseAND(1) == 1, F.col(f"{prefix}{i}")).otherwise(F.lit(1.0))
    return F.when(m < F.lit(1 << POW_BITS), acc).otherwise(F.pow(F.col(f"{prefix}0"), m))


def with_first_month(df: DataFrame, S, c, r, N, M, out: str = "_fire_month") -> DataFrame:
    """Add ``out`` = smallest m in [0, M] with balance_at(m) >= N; null if none or N <= 0.

    Staged as separate projections (inputs, candidate, powers, balances) so
    each generated method stays small; the powers of 1 + r are computed once
    per row and shared by the three checked months.
    """
    x = df.select("*", col_or(S).alias("_fS"), col_or(c).alias("_fc"), col_or(r).alias("_fr"),
                  col_or(N).alias("_fN"), col_or(M).alias("_fM"))
    S, c, r, N, M = (F.col(k) for k in ("_fS", "_fc", "_fr", "_fN", "_fM"))
    k = c / r
    ratio = (N + k) / F.nullif(S + k, F.lit(0.0))  # with a negative rate the balance tends to -k: N beyond it is never reached
    cand_r = F.ceil(F.log(ratio) / F.log(F.lit(1.0) + r))
    cand_0 = F.ceil((N - S) / c)
    cand = F.when(S >= N, F.lit(0)).when(r == 0, F.when(c > 0, cand_0)).when(ratio > 0, cand_r)
    x = x.withColumn("_fcand", cand.cast("long"))
    x = with_powers(x, F.lit(1.0) + r, prefix="_fp")
    tmp = ["_fS", "_fc", "_fr", "_fN", "_fM", "_fcand"] + [f"_fp{i}" for i in range(POW_BITS)]
    picks = []
    for j, d in enumerate((-1, 0, 1)):
        m, g, b = f"_fm{j}", f"_fg{j}", f"_fb{j}"
        x = x.withColumn(m, F.greatest(F.col("_fcand") + F.lit(d), F.lit(0)))
        x = x.withColumn(g, int_pow(m, prefix="_fp"))
        x = x.withColumn(b, F.when(r == 0, S + c * F.col(m)).otherwise(S * F.col(g) + c * (F.col(g) - F.lit(1.0)) / r))
        picks.append(F.when((F.col(m) <= M) & (F.col(b) >= N), F.col(m)))
        tmp += [m, g, b]
    found = F.when((N > 0) & F.col("_fcand").isNotNull(), F.coalesce(*picks)).cast("int")
    return x.withColumn(out, found).drop(*tmp)


def planner_inputs(ledger: DataFrame, filters=None, by: Sequence[str] = (), **overrides) -> DataFrame:
    """Per ``by``: average monthly income/expense from the ledger (rounded 2) and planner defaults.

    ``overrides`` replace defaults (literals); a 0 or missing income/expense
    takes the ledger average, as the planner does.
    """
    df = apply_filter(ledger, filters)
    g = df.groupBy(*by).agg(
        F.sum(income_amt()).alias("_inc"), F.sum(expense_amt()).alias("_exp"), F.count_distinct("year_month").alias("_n")
    )
    n = F.greatest(F.col("_n"), F.lit(1))
    vals = dict(FIRE_DEFAULTS)
    vals.update(overrides)
    avg_inc = round_dec(F.col("_inc").cast("double") / n)
    avg_exp = round_dec(F.col("_exp").cast("double") / n)
    inc = F.lit(float(vals["monthly_income"])) if vals.get("monthly_income") else avg_inc
    exp = F.lit(float(vals["monthly_expense"])) if vals.get("monthly_expense") else avg_exp
    return g.select(
        *by,
        inc.alias("monthly_income"),
        exp.alias("monthly_expense"),
        F.lit(float(vals["current_savings"])).alias("current_savings"),
        F.lit(float(vals["annual_return_pct"])).alias("annual_return_pct"),
        F.lit(float(vals["withdrawal_rate_pct"])).alias("withdrawal_rate_pct"),
        F.lit(int(vals["current_age"])).alias("current_age"),
        F.lit(int(vals["target_age"])).alias("target_age"),
    )


def _age_cols(month: Column, current_age: Column) -> list:
    age = current_age + month / F.lit(12.0)
    return [
        month.alias("fire_month"),
        round_dec(age, 1).alias("fire_age"),
        round_dec(age - current_age, 1).alias("years_to_fire"),
    ]


def _contribution() -> Column:
    return F.greatest(F.col("monthly_income") - F.col("monthly_expense"), F.lit(0.0))


def _horizon() -> Column:
    return (F.col("target_age") - F.col("current_age")) * 12


def fire_plan(inputs: DataFrame, by: Sequence[str] = (), compounding: str = "effective",
              inflation_pct: float | str | None = None) -> DataFrame:
    """FIRE number (25x annual expense), contribution, FIRE age and years to FIRE.

    ``compounding`` and ``inflation_pct`` (D6, here and below): see ``rate``;
    with an inflation all amounts are in today's money.
    """
    number = F.col("monthly_expense") * F.lit(12.0) * F.lit(25.0)
    r = rate("annual_return_pct", compounding, inflation_pct)
    x = with_first_month(inputs, "current_savings", _contribution(), r, number, _horizon())
    return x.select(
        *by,
        round_dec(number).alias("fire_number"),
        round_dec(_contribution()).alias("monthly_contribution"),
        *_age_cols(F.col("_fire_month"), F.col("current_age")),
    )


def fire_return_scenarios(inputs: DataFrame, by: Sequence[str] = (), deltas=RETURN_DELTAS, compounding: str = "effective",
                          inflation_pct: float | str | None = None) -> DataFrame:
    """FIRE age under return R - 2, R, R + 2 percentage points, floored at 0 (C17)."""
    arr = F.array(*[F.struct(F.lit(lbl).alias("scenario"), F.lit(float(d)).alias("delta")) for lbl, d in deltas])
    x = inputs.select("*", F.explode(arr).alias("s"))
    rr = F.greatest(F.lit(0.0), F.col("annual_return_pct") + F.col("s.delta"))
    number = F.col("monthly_expense") * F.lit(12.0) * F.lit(25.0)
    x = with_first_month(x, "current_savings", _contribution(), rate(rr, compounding, inflation_pct), number, _horizon())
    return x.select(*by, F.col("s.scenario").alias("scenario"), round_dec(rr).alias("annual_return_pct"),
                    *_age_cols(F.col("_fire_month"), F.col("current_age")))


def fire_withdrawal_scenarios(inputs: DataFrame, by: Sequence[str] = (), rates=WITHDRAWAL_RATES, compounding: str = "effective",
                              inflation_pct: float | str | None = None) -> DataFrame:
    """FIRE number and age for withdrawal rates 3/4/5 %, flagging the 4 % (25x) row."""
    x = inputs.select("*", F.explode(F.array(*[F.lit(float(w)) for w in rates])).alias("wr"))
    number = F.col("monthly_expense") * F.lit(12.0) / (F.col("wr") / F.lit(100.0))
    x = with_first_month(x, "current_savings", _contribution(), rate("annual_return_pct", compounding, inflation_pct), number, _horizon())
    return x.select(*by, F.col("wr").alias("withdrawal_rate_pct"), round_dec(number).alias("fire_number"),
                    *_age_cols(F.col("_fire_month"), F.col("current_age")),
                    (F.col("wr") == F.lit(DEFAULT_WITHDRAWAL)).alias("is_default_25x"))


def fire_projection(inputs: DataFrame, by: Sequence[str] = (), compounding: str = "effective",
                    inflation_pct: float | str | None = None) -> DataFrame:
    """Portfolio value per month from current to target age (the planner's chart series).

    Rate, contribution and the powers of 1 + r are computed once per entity
    before the months are generated; each generated row multiplies at most
    ``POW_BITS`` of them.
    """
    x = inputs.withColumn("_r", rate("annual_return_pct", compounding, inflation_pct)).withColumn("_c", _contribution())
    x = with_powers(x.where(_horizon() >= 0), F.lit(1.0) + F.col("_r"))  # no months when the target age has passed
    x = x.select(*by, "current_age", "current_savings", "_r", "_c", *[f"_g{i}" for i in range(POW_BITS)],
                 F.explode(F.sequence(F.lit(0), _horizon_of(x))).alias("m"))
    x = x.withColumn("_gm", int_pow("m"))
    S, c, r, g, m = F.col("current_savings"), F.col("_c"), F.col("_r"), F.col("_gm"), F.col("m")
    bal = F.when(r == 0, S + c * m).otherwise(S * g + c * (g - F.lit(1.0)) / r)
    return x.select(
        *by,
        m.alias("month"),
        round_dec(F.col("current_age") + m / F.lit(12.0), 4).alias("age"),
        round_dec(bal).alias("portfolio_value"),
    )


def _horizon_of(df: DataFrame) -> Column:
    return (F.col("target_age") - F.col("current_age")) * 12


def future_value(amount, r, months, prefix: str = "_g") -> Column:
    """Future value of a monthly contribution, closed form of fv = fv * (1 + r) + a;
    needs ``with_powers(df, 1 + r, prefix)``."""
    a, r, h = col_or(amount), col_or(r), col_or(months)
    return F.when(r == 0, a * h).otherwise(a * (int_pow(h, prefix) - F.lit(1.0)) / r)

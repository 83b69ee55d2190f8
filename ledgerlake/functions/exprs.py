"""Column-expression helpers shared by the operators.

All helpers return plain ``Column`` expressions built from
``pyspark.sql.functions``, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dec(c, scale: int = 2) -> Column:
    """Round half away from zero on the decimal value of a double.

    The integer part t = trunc(x) is split off (exact) and only the fraction
    x - t (exact by Sterbenz's lemma, |x - t| < 1) is rounded through
    ``decimal(28,8)``; then t is added back. Converting a fraction below 1 to
    8 decimals is exact in every engine, whereas converting a large double
    (above ~1e8) is not in all of them, so the result no longer depends on the
    engine or on the magnitude.
    """
    x = col_or(c)
    t = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")
    frac = F.round((x - t).cast("decimal(28,8)"), scale).cast("double")
    return t + frac


def dsum(c) -> Column:
    """Exact sum of a decimal column, returned as double."""
    return F.sum(col_or(c)).cast("double")


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(col_or(num), F.nullif(col_or(den), F.lit(0)))


def clip(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(col_or(c), F.lit(lo)), F.lit(hi))


def pct_change(cur, prev) -> Column:
    """100 * (cur - prev) / prev, null when prev is 0 or null; rounded to 2."""
    cur, prev = col_or(cur), col_or(prev)
    return round_dec(safe_div(F.lit(100.0) * (cur - prev), prev), 2)


def format_money(c, currency: str = "BYN") -> Column:
    """``1,234.56 BYN``; a dash when null. Rounded like ``round_dec`` (ties away from zero)."""
    return F.coalesce(F.concat(F.format_number(round_dec(c, 2), 2), F.lit(" " + currency)), F.lit("—"))


def format_pct(c) -> Column:
    """``+1.23%``; a dash when null. Rounded like ``round_dec`` (ties away from zero)."""
    return F.coalesce(F.format_string("%+.2f%%", round_dec(c, 2)), F.lit("—"))

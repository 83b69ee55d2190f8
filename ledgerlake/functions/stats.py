"""Order-free moments of decimal money columns.

``stddev_samp``/``stddev_pop`` over doubles give results that depend on the
order rows reach the aggregate (and on the engine). Sums of a decimal column
and of its square are exact, so ``n*S2 - S1^2`` is exact too; only the final
division and square root are done in double. The result is the same for any
partitioning, on every run. Where a square or sum would exceed decimal(38), the
double moments take its place instead of an overflow error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import col_or, safe_div

HALF_BITS = 30


def sum_sq(c, over=None) -> Column:
    """Exact sum of squares of a decimal column; null when a square or the sum exceeds decimal(38)."""
    c = col_or(c)
    sq = F.try_multiply(c, c)
    put = (lambda e: e) if over is None else (lambda e: e.over(over))
    return F.when(put(F.count(sq)) == put(F.count(c)), put(F.try_sum(sq)))


def has_halves(dtype: T.DataType) -> bool:
    """Whether ``halves`` holds a value of this type exactly: a decimal of up to 18 digits, 6 of them after the point."""
    return isinstance(dtype, T.DecimalType) and dtype.precision <= 18 and 0 <= dtype.scale <= 6


def halves(c, dtype: T.DecimalType) -> tuple[Column, Column]:
    """A decimal's whole units of 10**-scale as two longs: units >> 30 (signed) and the low 30 bits.

    Sums of each half are exact for more than 8 * 10**9 rows a group, whatever their amounts, and take 8 bytes
    of an aggregate's row where a decimal sum takes 32.
    """
    units = (col_or(c) * F.lit(10**dtype.scale)).cast("long")
    return F.shiftright(units, HALF_BITS), units.bitwiseAND(F.lit((1 << HALF_BITS) - 1))


def from_halves(hi, lo, dtype: T.DecimalType) -> Column:
    """The sum that two sums of ``halves`` stand for, in the type of ``sum`` over the decimal itself."""
    units = col_or(hi).cast("decimal(19,0)") * F.lit(1 << HALF_BITS) + col_or(lo).cast("decimal(19,0)")
    return (units * F.lit(Decimal(1).scaleb(-dtype.scale))).cast(T.DecimalType(dtype.precision + 10, dtype.scale))


def var_numerator(n, s1, s2, scale: int = 0) -> Column:
    """n*S2 - S1^2 as double (exact before the cast); null when it exceeds decimal(38).

    With a ``scale`` the sums are whole numbers of 10**-scale, and the result is one rounding away from the exact value.
    """
    n, s1, s2 = col_or(n), col_or(s1), col_or(s2)
    exact = F.try_subtract(F.try_multiply(n, s2), F.try_multiply(s1, s1))
    return F.concat(exact.cast("string"), F.lit(f"E-{2 * scale}")).cast("double") if scale else exact.cast("double")


def stddev_samp_from(n, s1, s2, wide=None, scale: int = 0) -> Column:
    """Sample std from count, exact sum and exact sum of squares (in units of 10**-scale); null when n < 2.

    ``wide`` (``stddev_samp`` of the same rows as double) stands in where the
    exact numerator exceeds decimal(38).
    """
    n = col_or(n)
    exact = F.sqrt(safe_div(var_numerator(n, s1, s2, scale), n * (n - F.lit(1))))
    return exact if wide is None else F.coalesce(exact, F.when(n > 1, col_or(wide)))


def stddev_pop_from(n, s1, s2, wide=None) -> Column:
    """Population std; 0 for n == 1, null for n == 0; ``wide`` as above (``stddev_pop``)."""
    n = col_or(n)
    exact = F.sqrt(safe_div(var_numerator(n, s1, s2), n * n))
    return exact if wide is None else F.coalesce(exact, F.when(n > 0, col_or(wide)))


def mean_from(n, s1) -> Column:
    return safe_div(col_or(s1).cast("double"), col_or(n))

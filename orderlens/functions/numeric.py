"""Exact money arithmetic.

Money is DECIMAL(15,2) throughout.  Divisions that must be rounded (means,
percentages, growth) are done on integer cents with a half-away-from-zero
integer quotient, so no binary floating point enters before the final value;
the result is emitted as DOUBLE, which is exact for a 2-dp value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
TOTAL = "decimal(28,2)"  # sums of money
PRICE = "decimal(12,2)"
WIDE = "decimal(38,0)"
PCT_TYPE = "decimal(5,2)"


def dec(value: str) -> Column:
    """Decimal literal (a Python float literal would be a DOUBLE)."""
    return F.lit(Decimal(value))


def cents(c: Column) -> Column:
    """Money value as an exact integer count of cents."""
    return (c * 100).cast(WIDE)


def rhu_div(num: Column, den: Column) -> Column:
    """round(num / den) half away from zero, for integers and den > 0; NULL when den is 0."""
    n = num.cast(WIDE)
    d = F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    pos = F.call_function("div", n * 2 + d, d * 2)
    neg = -F.call_function("div", -n * 2 + d, d * 2)
    return F.when(n >= 0, pos).otherwise(neg)


def avg_money(total: Column, count: Column) -> Column:
    """Mean of money values rounded to 2 dp (from an exact total and a count), as DOUBLE."""
    return rhu_div(cents(total), count) / F.lit(100.0)


def ratio_pct(num: Column, den: Column, digits: int = 2) -> Column:
    """100 * num / den rounded to ``digits`` dp, exact for decimal inputs with <= 2 dp."""
    scale = 10 ** digits
    return rhu_div(cents(num) * (100 * scale), cents(den)) / F.lit(float(scale))


def ratio_pct_int(num: Column, den: Column, digits: int = 2) -> Column:
    """100 * num / den rounded, for integer inputs."""
    scale = 10 ** digits
    return rhu_div(num.cast(WIDE) * (100 * scale), den) / F.lit(float(scale))


def round_money(c: Column, digits: int = 2) -> Column:
    """Round a decimal half away from zero and emit DOUBLE."""
    return F.round(c, digits).cast("double")


def money_millions_text(total: Column) -> Column:
    """'R$ 5.2M': millions with one decimal, half-even on the exact value."""
    tenths = rhe_div(cents(total), F.lit(10 ** 7))
    return F.concat(F.lit("R$ "), F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("M"))


def money_units_text(total: Column) -> Column:
    """'R$ 18.450': whole units, half-even, '.' as thousands separator."""
    units = rhe_div(cents(total), F.lit(100))
    return F.concat(F.lit("R$ "), F.translate(F.format_number(units, 0), ",", "."))


def rhe_div(num: Column, den: Column) -> Column:
    """round(num / den) half to even (Python / pandas rounding), integers, den > 0."""
    n = F.abs(num.cast(WIDE))
    d = F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    q = F.call_function("div", n, d)
    r2 = (n - q * d) * 2
    mag = F.when(r2 > d, q + 1).when((r2 == d) & (q % 2 == 1), q + 1).otherwise(q)
    return F.when(num.cast(WIDE) < 0, -mag).otherwise(mag)


def pct_of(num: Column, den: Column, digits: int = 1, half_even: bool = True) -> Column:
    """100 * num / den for money values, rounded (half-even by default, as Python's round)."""
    scale = 10 ** digits
    div = rhe_div if half_even else rhu_div
    return div(cents(num) * (100 * scale), cents(den)) / F.lit(float(scale))

"""Exact rounding and clamping.

The reference rounds ``numeric`` values half away from zero.  Rounding a ratio
through a scale-6 decimal quotient first can round twice (``50/10001`` becomes
``0.005000`` and then ``0.01``), which large groups hit.  These helpers round
``num/den`` in integer arithmetic instead, for non-negative operands:

    round(num / den, s) = (2 * num * 10^s + den) div (2 * den) / 10^s

and hand the result out as DOUBLE, the exact nearest double of that decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_sql(num: str, den: str, scale: int) -> str:
    """SQL text for round(num/den, scale) half-up; NULL when den is NULL or 0."""
    p = 10 ** scale
    d = f"NULLIF({den}, 0)"
    return f"CAST((2 * ({num}) * {p} + {d}) div (2 * {d}) AS DOUBLE) / {p}"


def ratio(num: str, den: str, scale: int) -> Column:
    """Column for round(num/den, scale) over aggregated integral columns."""
    return F.expr(ratio_sql(num, den, scale))


def hundredths(total: str) -> Column:
    """``SUM(x * w / 100.0)``: an integral sum divided by 100 is exact at 2 decimals."""
    return F.expr(f"CAST({total} AS DOUBLE) / 100")


def clamp(c, lo: int = 0, hi: int = 100) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))

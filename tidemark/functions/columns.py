"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Six decimals, halves up, with the border a little off the half so that summation noise cannot flip it."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.501) / 1e6


def q6(e: str) -> str:
    """`r6` in SQL."""
    return f"floor(({e}) * 1e6 + 0.501) / 1e6"


def r4(c: Column | str) -> Column:
    """Four decimals, as `r6`."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e4 + 0.501) / 1e4


def q4(e: str) -> str:
    """`r4` in SQL."""
    return f"floor(({e}) * 1e4 + 0.501) / 1e4"


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def positive_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where b is above 0, else null."""
    b = F.col(b) if isinstance(b, str) else b
    return F.when(b > 0, ratio(a, b))


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return w.rowsBetween(1 - n, 0)


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness; null for fewer than 3 values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than 4 values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def r_squared(y: Column, x: Column) -> Column:
    """R squared of y on x as an aggregate; 0 for a constant y."""
    return F.when(F.var_pop(F.when(x.isNotNull(), y)) == 0, F.lit(0.0)).otherwise(F.regr_r2(y, x))


#: Market capitalisation limits of the six size tiers, smallest tier first.
TIER_LIMITS = (50e6, 300e6, 2e9, 10e9, 200e9)


def size_tier(cap: Column | str, limits: tuple[float, ...] = TIER_LIMITS) -> Column:
    """1 to 6 by the number of limits that the capitalisation reaches; null for null."""
    c = F.col(cap) if isinstance(cap, str) else cap
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for k, limit in enumerate(limits):
        out = out.when(c < limit, k + 1)
    return out.otherwise(len(limits) + 1)


def active_on(first: Column | str, last: Column | str, removed: Column | str, day: Column | str) -> Column:
    """Listed on a day: begun, not ended, and not removed on or before it; null ends are open."""
    first, last, removed, day = (F.col(c) if isinstance(c, str) else c for c in (first, last, removed, day))
    return (first <= day) & (last.isNull() | (last >= day)) & (removed.isNull() | (removed > day))

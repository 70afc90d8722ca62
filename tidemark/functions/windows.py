"""Per-instrument window expressions over (code, dt).

A code's bars form one window partition. Bars are one row per (code, day), so that
partition is bounded by the calendar however many raw rows the instrument has: the hot
instruments are already folded by the bar aggregation, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import c

KEY, DAY = "code", "dt"


def series(key: str | list[str] = KEY, order: str = DAY) -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else series()).rowsBetween(-(n - 1), 0)


def before_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else series()).rowsBetween(-n, -1)


def next_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else series()).rowsBetween(1, n)


def upto(w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else series()).rowsBetween(Window.unboundedPreceding, 0)


def roll(agg, x, n: int, min_rows: int = 1, w: WindowSpec | None = None) -> Column:
    """``agg(x)`` over the last n rows, NULL until ``min_rows`` non-NULL values are there."""
    frame = last_n(n, w)
    value = agg(c(x)).over(frame)
    if min_rows <= 1:
        return value
    return F.when(F.count(c(x)).over(frame) >= min_rows, value)


def mean_n(x, n, min_rows=1, w=None) -> Column:
    return roll(F.avg, x, n, min_rows, w)


def sum_n(x, n, min_rows=1, w=None) -> Column:
    return roll(F.sum, x, n, min_rows, w)


def std_n(x, n, min_rows=2, w=None) -> Column:
    return roll(F.stddev_samp, x, n, max(min_rows, 2), w)


def min_n(x, n, min_rows=1, w=None) -> Column:
    return roll(F.min, x, n, min_rows, w)


def max_n(x, n, min_rows=1, w=None) -> Column:
    return roll(F.max, x, n, min_rows, w)


def lag(x, n=1, w=None) -> Column:
    return F.lag(c(x), n).over(w if w is not None else series())


def lead(x, n=1, w=None) -> Column:
    return F.lead(c(x), n).over(w if w is not None else series())


def momentum(n: int, x="close", w=None) -> Column:
    """Percent change over n own bars."""
    return (c(x) / lag(x, n, w) - 1) * 100


def power_means(x, n) -> list[Column]:
    """Row count and the means of x, x^2, x^3, x^4 over the last n rows."""
    f = last_n(n)
    v = c(x)
    return [F.count(v).over(f).cast("double"), *(F.avg(p).over(f) for p in (v, v * v, v * v * v, v * v * v * v))]


def _central(m, e1, e2, e3, e4) -> tuple[Column, Column, Column, Column]:
    """Row count and 2nd-4th central moments of the window from power means.

    Plain averages slide much faster than the moment aggregates; a spread below 1e-10 of
    the mean square counts as none.
    """
    m2 = F.when(e2 - e1 * e1 > e2 * 1e-10, e2 - e1 * e1)
    m3 = e3 - e1 * e2 * 3 + e1 * e1 * e1 * 2
    m4 = e4 - e1 * e3 * 4 + e1 * e1 * e2 * 6 - e1 * e1 * e1 * e1 * 3
    return m, m2, m3, m4


def skewness(means, min_rows) -> Column:
    """Bias-corrected (G1) skewness from ``power_means``. A window is evaluated as often as an expression
    names it, so the means should be columns."""
    m, m2, m3, _ = _central(*means)
    g = m3 / F.nullif(m2 * F.sqrt(m2), F.lit(0.0))
    return F.when(m >= max(min_rows, 3), g * F.sqrt(m * (m - 1)) / F.nullif(m - 2, F.lit(0.0)))


def kurtosis(means, min_rows) -> Column:
    """Bias-corrected (G2) excess kurtosis from ``power_means``, which should be columns."""
    m, m2, _, m4 = _central(*means)
    g = m4 / F.nullif(m2 * m2, F.lit(0.0)) - 3
    value = (m - 1) / F.nullif((m - 2) * (m - 3), F.lit(0.0)) * ((m + 1) * g + 6)
    return F.when(m >= max(min_rows, 4), value)


def skew_n(x, n, min_rows) -> Column:
    """Rolling ``skewness``."""
    return skewness(power_means(x, n), min_rows)


def kurt_n(x, n, min_rows) -> Column:
    """Rolling ``kurtosis``."""
    return kurtosis(power_means(x, n), min_rows)

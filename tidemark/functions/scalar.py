"""Column helpers without state: guarded division, clipping, first-match tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def safe_div(a, b, default=0.0) -> Column:
    """a / b where |b| > 1e-10, otherwise ``default`` (also for a NULL divisor)."""
    a, b = c(a), c(b)
    return F.when(F.abs(b) > EPS, a / F.nullif(b, F.lit(0.0))).otherwise(lit_or_col(default))


def div0(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return c(a) / F.nullif(c(b).cast("double"), F.lit(0.0))


def nz(x, value=0.0) -> Column:
    return F.coalesce(c(x), lit_or_col(value))


def corr(x, y, w=None) -> Column:
    """Pearson correlation of the rows that have both values; NULL where either is constant, which
    ``F.corr`` takes for an error."""
    x, y = c(x).cast("double"), c(y).cast("double")
    parts = F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))
    cov, sx, sy = parts if w is None else (p.over(w) for p in parts)
    return cov / F.nullif(sx * sy, F.lit(0.0))


def exact_sum(x, unit: float = 1e6, over=None) -> Column:
    """Sum in whole ``1 / unit``, the same in whatever order rows are added, so that equal sums stay equal; NaN counts as NULL."""
    total = F.sum(F.floor(nan_to_null(x) * unit + 0.5).cast("decimal(20,0)"))
    return (total if over is None else total.over(over)).cast("double") / unit


def exact_avg(x, unit: float = 1e9) -> Column:
    return exact_sum(x, unit) / F.nullif(F.count(nan_to_null(x)), F.lit(0))


def clip(x, lo=None, hi=None) -> Column:
    """Bounded value; NULL stays NULL (least/greatest alone would skip it)."""
    x = c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """0/1 double; a NULL condition counts as 0."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def one_if(cond: Column) -> Column:
    """0/1 integer; a NULL condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def tiers(pairs: Sequence[tuple[Column, object]], otherwise) -> Column:
    """First condition that holds decides the value."""
    head, *rest = pairs
    expr = reduce(lambda acc, p: acc.when(p[0], lit_or_col(p[1])), rest, F.when(head[0], lit_or_col(head[1])))
    return expr.otherwise(lit_or_col(otherwise))


def present(*items: Column) -> Column:
    """Array of the non-NULL items, in the given order."""
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def nan_to_null(x) -> Column:
    x = c(x).cast("double")
    return F.when(~F.isnan(x), x)


def rd(x, digits: int = 4) -> Column:
    """Rounded for output; the nudge makes exact halves round alike whatever the summation order."""
    return F.round(c(x).cast("double") + 10.0 ** -(digits + 4), digits)

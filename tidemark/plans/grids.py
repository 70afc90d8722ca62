"""Many weightings of the same factors judged at once: the grid is a table, not a loop of jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div0, one_if
from ..operators.studies import RISK_FREE, YEAR_DAYS

Weights = Sequence[float]


def simplex(n: int, parts: int, least: int = 1) -> list[tuple[float, ...]]:
    """All weightings of n factors in steps of 1 / parts that sum to one, with ``least`` or more factors in use, in lexical order."""

    def shares(left: int, k: int) -> Iterator[tuple[int, ...]]:
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            yield from ((i, *rest) for rest in shares(left - i, k - 1))

    return [tuple(i / parts for i in s) for s in sorted(shares(parts, n)) if sum(i > 0 for i in s) >= least]


def four_factor_weights(momentum: Sequence[float], slope: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """Momentum and slope weights on a grid; turnover and strength share what is left four to five. All have two decimals."""
    return [(m, s, round((1 - m - s) * 4 / 9, 2), round((1 - m - s) * 5 / 9, 2)) for m, s in product(momentum, slope)]


def _mixed(d: DataFrame, factors: Sequence[str], weights: Sequence[Weights]) -> DataFrame:
    """Every row once for each weighting: ``combo`` and the mixed ``score``, rounded so that equal mixtures tie. Factors without
    a weight do not count, also where they are NULL."""
    table = F.array(*[F.struct(F.lit(i).alias("combo"), F.array(*[F.lit(float(x)) for x in w]).alias("w")) for i, w in enumerate(weights)])
    each = d.select("*", F.explode(table).alias("_g")).select(*d.columns, "_g.combo", F.col("_g.w").alias("_w"))
    part = lambda i, f: F.when(F.col("_w")[i] == 0, 0.0).otherwise(F.col(f) * F.col("_w")[i])
    return each.withColumn("score", F.round(sum((part(i, f) for i, f in enumerate(factors)), F.lit(0.0)), 9)).drop("_w")


def weight_separation(panel: DataFrame, factors: Sequence[str], weights: Sequence[Weights], outcome: str = "forward_return", edge: float = 0.25, regime: str | None = None, least: int = 20) -> DataFrame:
    """Per weighting (``combo``, its place in ``weights``): mean outcome of each date's best quarter by the mixed score minus that of its
    worst, and the share of gains in the best. Ranks are average ranks within a date, over the rows with an outcome and all factors.
    With ``regime`` each of its values is judged too, beside ``ALL``. Weightings with under ``least`` rows on either side have no figures.

    A date holds one row per industry, which is what a window holds at a time."""
    d = panel.where(F.col(outcome).isNotNull())
    for f in factors:
        d = d.where(F.col(f).isNotNull())
    kinds = F.array(F.lit("ALL")) if regime is None else F.array_compact(F.array(F.lit("ALL"), F.col(regime)))
    d = _mixed(d.select("dt", F.col(outcome).alias("_o"), kinds.alias("_kinds"), *factors), factors, weights).select("dt", "_o", "_kinds", "combo", "score")
    day = Window.partitionBy("combo", "dt")
    place = F.rank().over(day.orderBy(F.desc("score"))) + (F.count(F.lit(1)).over(Window.partitionBy("combo", "dt", "score")) - 1) / 2
    d = d.select("combo", "_o", "_kinds", (place / F.count(F.lit(1)).over(day)).alias("_rk"))
    top, bottom = F.col("_rk") <= edge, F.col("_rk") >= 1 - edge
    sums = d.groupBy("combo", "_kinds").agg(
        F.sum(one_if(top)).alias("n_top"), F.sum(one_if(bottom)).alias("n_bottom"), F.sum(F.when(top, F.col("_o"))).alias("_t"), F.sum(F.when(bottom, F.col("_o"))).alias("_b"), F.sum(one_if(top & (F.col("_o") > 0))).alias("_w")
    )
    out = sums.select("*", F.explode("_kinds").alias("regime")).groupBy("regime", "combo").agg(*[F.sum(c).alias(c) for c in ("n_top", "n_bottom", "_t", "_b", "_w")])
    enough = (F.col("n_top") >= least) & (F.col("n_bottom") >= least)
    mean_top, mean_bottom = div0("_t", "n_top"), div0("_b", "n_bottom")
    return out.select(
        "regime", "combo", "n_top", "n_bottom", *[F.when(enough, x).alias(c) for c, x in (("top_avg", mean_top), ("bottom_avg", mean_bottom), ("separation", mean_top - mean_bottom), ("top_win", div0("_w", "n_top") * 100))]
    )


def portfolio_grid(panels: dict[int, DataFrame], factors: Sequence[str], weights: Sequence[Weights], tops: Sequence[int], max_dd: float = 0.35) -> DataFrame:
    """Top-n portfolios for every lookback (a key of ``panels``: code, dt, factors, next_ret), weighting and n: days, log of the final
    value, deepest fall, Sharpe ratio, and whether the fall stays above ``max_dd``. One ranking a weighting and date serves all n."""
    parts = [p.where(F.col("next_ret").isNotNull()).select(F.lit(k).alias("lookback"), "code", "dt", "next_ret", *factors) for k, p in panels.items()]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = _mixed(d, factors, weights).select("lookback", "code", "dt", "next_ret", "combo", "score").where("score is not null")
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("lookback", "combo", "dt").orderBy(F.desc("score"), "code"))).where(F.col("_k") <= max(tops))
    held = d.select("lookback", "combo", "dt", "next_ret", F.explode(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t >= F.col("_k"))).alias("top"))
    daily = held.groupBy("lookback", "combo", "top", "dt").agg(F.avg("next_ret").alias("ret"))
    w = Window.partitionBy("lookback", "combo", "top").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    nav = daily.withColumn("_s", F.sum(F.log1p("ret")).over(w))
    nav = nav.withColumn("_dd", F.exp(F.col("_s") - F.greatest(F.max("_s").over(w), F.lit(0.0))) - 1)
    out = nav.groupBy("lookback", "combo", "top").agg(
        F.count(F.lit(1)).alias("n_days"), F.max_by("_s", "dt").alias("log_return"), F.min("_dd").alias("max_drawdown"),
        (div0(F.avg("ret") - RISK_FREE / YEAR_DAYS, F.stddev_samp("ret")) * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("sharpe"),
    )
    return out.withColumn("eligible", F.col("max_drawdown") > -max_dd)

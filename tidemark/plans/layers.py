"""Picks by layers (market, then industries, then instruments) from models that are refitted as time goes on.

A score may only come from a model fitted before its date. The model versions are a table of dates;
which version scores a date is an as-of join, and all versions score in one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import tiers
from ..operators.cross import top_n
from ..sources.ingest import as_day, trading_calendar


def version_dates(days: DataFrame, since: str | Column, every: int = 5) -> DataFrame:
    """(version, asof_dt): models are fitted on data up to the date before the first scored one and before
    every ``every``-th after it. The first date of ``days`` has none before and is never scored."""
    cal = trading_calendar(days)
    first = F.greatest(cal.where(F.col("dt") >= as_day(since)).agg(F.min("date_idx")).scalar(), F.lit(2))
    k = F.col("date_idx") - (first - 1)
    last = cal.agg(F.max("date_idx")).scalar()
    fits = cal.where((k >= 0) & (k % every == 0) & (F.col("date_idx") < last))
    return fits.select((k / every).cast("int").alias("version"), F.col("dt").alias("asof_dt"))


def newest_version(days: DataFrame, versions: DataFrame) -> DataFrame:
    """(dt, version, asof_dt): the newest version fitted before each date; dates without one are left out."""
    both = days.select("dt").distinct().withColumn("_v", F.lit(None).cast("struct<version:int,asof_dt:date>"))
    both = both.unionByName(versions.select(F.col("asof_dt").alias("dt"), F.struct("version", "asof_dt").alias("_v")))
    # a row per date and version: a version of the same date comes after the date it may not score
    w = Window.orderBy("dt", F.col("_v").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    d = both.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where("_v is null and _m is not null")
    return d.select("dt", "_m.version", "_m.asof_dt")


def score_by_version(rows: DataFrame, models: Mapping[int, PipelineModel], out: str = "prediction") -> DataFrame:
    """Rows (with ``version``) scored each by its own version's model, as one plan; rows of a version
    without a model are left out."""
    if not models:
        raise ValueError("no model given")
    kept = [*rows.columns, out]
    return reduce(DataFrame.unionByName, [m.transform(rows.where(F.col("version") == v)).select(*kept) for v, m in models.items()])


#: Regime by the market model's probability of a rise, and the engine that picks in it (fixed values).
BULL, BEAR = 0.6, 0.4
ENGINE = {"bull": "momentum", "range": "reversion", "bear": "breakout"}


def layered_picks(
    market: DataFrame,
    sectors: DataFrame,
    instruments: DataFrame,
    n_sectors: int = 5,
    n: int = 10,
    gate: float = 0.55,
    engine: Mapping[str, str] = ENGINE,
) -> DataFrame:
    """The instruments to hold on each date (dt, code, sector, regime, up_prob, sector_rank, win_prob, rank, other columns of ``instruments``).

    ``market`` has dt and up_prob, ``sectors`` dt, sector and prob, ``instruments`` dt, code, sector and a column p_<engine> for each
    engine. The market's probability gives the regime and with it the engine; instruments of the date's ``n_sectors``
    best industries (ties by sector) whose engine's probability reaches ``gate`` are ranked by it (ties by code), the first ``n``
    stay. NULL probabilities never pass; a date without a market row is a range; dates without an industry have no picks."""
    best = top_n(sectors.where("prob is not null"), ["dt"], "prob", n_sectors, tie="sector", out="sector_rank").select("dt", "sector", "sector_rank")
    d = instruments.join(best, ["dt", "sector"]).join(market.select("dt", "up_prob"), "dt", "left")
    up = F.coalesce("up_prob", F.lit(0.5))
    d = d.withColumn("regime", tiers([(up > BULL, "bull"), (up < BEAR, "bear")], "range"))
    d = d.withColumn("win_prob", tiers([(F.col("regime") == k, F.col(f"p_{e}")) for k, e in engine.items()], None))
    picks = top_n(d.where(F.col("win_prob") >= gate), ["dt"], "win_prob", n, out="rank")
    rest = [c for c in instruments.columns if c not in ("dt", "code", "sector", *[f"p_{e}" for e in engine.values()])]
    return picks.select("dt", "code", "sector", "regime", "up_prob", "sector_rank", "win_prob", "rank", *rest)


def layer_summary(picks: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Per regime: days, picks, and for each outcome in percent the share above zero and the mean."""
    stats = [e for c in outcomes for e in (F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("int"))).alias(f"{c}_win_rate"), F.avg(c).alias(f"{c}_mean"))]
    return picks.groupBy("regime").agg(F.countDistinct("dt").alias("n_days"), F.count(F.lit(1)).alias("n_picks"), *stats)

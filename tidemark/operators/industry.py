"""Industry roll-ups, breadth inside industries, relative strength and zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles, with_pct_rank
from ..functions.scalar import clip, div0, exact_avg, flag, nz, one_if, present, rd, tiers
from ..functions.windows import before_n, lag, last_n, max_n, mean_n, momentum, series
from . import indicators as ind
from .snapshots import latest_rows

# Fixed thresholds: labels of relative momentum and of persistence, weights of the scores.
STRONG_LEAD, LEAD = 5.0, 2.0
PERSISTENT_HIGH, PERSISTENT_MEDIUM = 7.0, 5.0
PERSISTENCE_WEIGHTS = {
    "momentum_score": 0.30, "slope_score": 0.25, "turnover_score": 0.20, "relative_score": 0.25, "stability_score": 0.0,
}


def persistence_label(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return tiers([(s >= PERSISTENT_HIGH, "high"), (s >= PERSISTENT_MEDIUM, "medium")], "low")


def rollup(bars: DataFrame, members: DataFrame, min_members: int = 3, reversal_min: float = 5.0) -> DataFrame:
    """Newest momentum of the members per industry: mean, median, shares, reversal flag."""
    d = bars.select(
        "code", "dt", momentum(20).alias("r20"), momentum(5).alias("r5"),
        one_if(F.col("close") > mean_n("close", 20, 20)).alias("a20"), one_if(F.col("close") > mean_n("close", 5, 5)).alias("a5"),
    )
    newest = latest_rows(d, min_rows=21).where("r20 is not null").join(members.select("code", "industry"), "code")
    agg = newest.groupBy("industry").agg(
        F.count(F.lit(1)).alias("stock_count"), F.avg("r20").alias("avg_return_20d"), F.avg("r5").alias("avg_return_5d"),
        (F.avg(one_if(F.col("r20") > 0)) * 100).alias("pct_positive"),
        (F.avg("a20") * 100).alias("pct_above_ma20"), (F.avg("a5") * 100).alias("pct_above_ma5"),
    ).where(F.col("stock_count") >= min_members)
    med = exact_percentiles(newest, ["industry"], "r20", {"median_return_20d": 0.5})
    strength = F.col("avg_return_5d") - F.col("avg_return_20d")
    d = agg.join(med, "industry").withColumn("reversal_strength", strength)
    d = d.withColumn("is_reversal", (F.col("avg_return_20d") < 0) & (F.col("reversal_strength") > reversal_min))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_return_20d"), "industry")))


def leading(children: DataFrame, parents: DataFrame, n: int = 20) -> DataFrame:
    """Newest n-bar return of each child minus its parent's, labelled and ranked (own bars on both sides)."""
    kids = latest_rows(children.withColumn("ret", momentum(n)), min_rows=n + 1).select("code", "name", "parent", "parent_name", "ret")
    par = latest_rows(parents.withColumn("ret", momentum(n)), min_rows=n + 1).select(F.col("code").alias("parent"), F.col("ret").alias("_p"))
    d = kids.join(par, "parent").withColumn("excess", F.col("ret") - F.col("_p")).drop("_p")
    label = tiers([(F.col("excess") >= STRONG_LEAD, "strong_lead"), (F.col("excess") >= LEAD, "lead"), (F.col("excess") >= 0, "in_line")], "lagging")
    d = d.withColumn("label", label)
    # one row per industry: the ranking table is bounded by the industry dimension
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("excess"), "code"))).withColumn(
        "rank_in_parent", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("excess"), "code"))
    )


def limit_moves(panel: DataFrame, members: DataFrame, level: str, board: Column | None = None) -> DataFrame:
    """Limit-up/-down counts and rates per (date, industry); wide boards move up to 20%."""
    limit = F.when(board, 19.5).otherwise(9.5) if board is not None else F.lit(9.5)
    d = panel.join(members.select("code", level), "code").groupBy("dt", level).agg(
        F.sum(one_if(F.col("pct_chg") >= limit)).alias("lt_count"),
        F.sum(one_if(F.col("pct_chg") <= -limit)).alias("dt_count"),
        F.sum(one_if(F.col("pct_chg") > 0)).alias("_up"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return d.select(
        "dt", level, F.col("lt_count").cast("double").alias("lt_count"), F.col("dt_count").cast("double").alias("dt_count"), "n_total",
        (F.col("lt_count") / F.col("n_total") * 100).alias("lt_rate"),
        (F.col("_up") / F.col("n_total") * 100).alias("up_pct"),
        nz(div0("lt_count", F.col("lt_count") + F.col("dt_count"))).alias("lt_to_dt_ratio"),
    )


def industry_day(panel: DataFrame, members: DataFrame, level: str) -> DataFrame:
    """Mean change per (date, industry) and its percent rank among industries of the date."""
    d = panel.join(members.select("code", level), "code").groupBy("dt", level).agg(exact_avg("pct_chg").alias("ind_chg"))
    return with_pct_rank(d, ["dt"], "ind_chg", "ind_rank")


def industry_features(features: DataFrame, members: DataFrame, level: str, means: Sequence[str], stds: Sequence[str]) -> DataFrame:
    d = features.join(members.select("code", level), "code")
    return d.groupBy("dt", level).agg(
        *[F.avg(x).alias(f"{x}_mean") for x in means], *[F.stddev_samp(x).alias(f"{x}_std") for x in stds]
    )


def market_features(features: DataFrame, means: Sequence[str], stds: Sequence[str], quartiles: Sequence[str]) -> DataFrame:
    d = features.groupBy("dt").agg(
        *[F.avg(x).alias(f"{x}_mean") for x in means], *[F.stddev_samp(x).alias(f"{x}_std") for x in stds]
    )
    for x in quartiles:
        d = d.join(exact_percentiles(features, ["dt"], x, {f"{x}_q25": 0.25, f"{x}_q75": 0.75}), "dt", "left")
    return d


def margin_divergence(margin: DataFrame, members: DataFrame, industry_bars: DataFrame, level: str) -> DataFrame:
    """Mean balance of the last 5 dates against dates 6-20, next to the 5-bar price change."""
    dates = margin.select("dt").distinct().orderBy(F.desc("dt")).limit(20)
    ranked = dates.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("dt"))))
    d = margin.join(ranked, "dt").join(members.select("code", level), "code")
    agg = d.groupBy(level).agg(
        F.avg(F.when(F.col("_k") <= 5, F.col("rzye"))).alias("_new"), F.avg(F.when(F.col("_k") > 5, F.col("rzye"))).alias("_old")
    ).where("_old > 0 and _new is not null")
    price = latest_rows(industry_bars.withColumn("price_change", nz(momentum(5)))).select(F.col("code").alias(level), "price_change")
    d = agg.join(price, level).select(level, ((F.col("_new") / F.col("_old") - 1) * 100).alias("margin_change"), "price_change")
    return d.withColumn("diverges", (F.col("margin_change") < -3) & (F.col("price_change") > 0))


def crowding(industry_bars: DataFrame, n: int = 80, percentile: float = 90.0) -> DataFrame:
    """Share of the day's amount against the n previous shares of the same industry."""
    totals = industry_bars.groupBy("dt").agg(F.sum("amount").alias("_t"))
    d = industry_bars.join(totals, "dt").withColumn("share", F.col("amount") / (F.col("_t") + 1e-10))
    d = d.select("code", "dt", "share", nz(momentum(5)).alias("mom5"), F.collect_list("share").over(before_n(n)).alias("_h"))
    pct = F.size(F.filter("_h", lambda v: v < F.col("share"))) / F.lit(float(n)) * 100
    d = d.where(F.size("_h") >= n).withColumn("percentile", pct)
    return d.select("code", "dt", "share", "mom5", "percentile", ((F.col("percentile") >= percentile) & (F.col("mom5") < 0)).alias("crowded"))


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Last non-NULL close per code and ISO week."""
    return bars.where("close is not null").groupBy(
        "code", F.extract(F.lit("YEAROFWEEK"), F.col("dt")).alias("iso_year"), F.weekofyear("dt").alias("iso_week")
    ).agg(F.max_by("close", "dt").alias("close"), F.max("dt").alias("dt"))


def weekly_momentum(weekly: DataFrame, window: int = 4) -> DataFrame:
    """Weekly score clip(5 + change%, 0, 10), length of the trailing run at 6 or more, confirmation."""
    d = weekly.select("code", "dt", clip(momentum(window) + 5, 0, 10).alias("score")).where("score is not null")
    breaks = F.sum(one_if(F.col("score") < 6)).over(series().rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_g", breaks)
    run = F.sum(one_if(F.col("score") >= 6)).over(Window.partitionBy("code", "_g").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("sustained_weeks", run)
    return d.select("code", "dt", F.col("score").alias("weekly_momentum"), "sustained_weeks",
                    ((F.col("score") >= 6) & (F.col("sustained_weeks") >= 2)).alias("weekly_confirmed"))


def weekly_filter(persistence: DataFrame, weekly_newest: DataFrame, penalty: float = 1.5) -> DataFrame:
    """Score minus the penalty (not below 0) where the week does not confirm; label renewed."""
    d = persistence.join(weekly_newest.select("code", "weekly_confirmed"), "code", "left")
    score = F.when(~F.col("weekly_confirmed"), F.greatest(F.col("persistence_score") - penalty, F.lit(0.0))).otherwise(F.col("persistence_score"))
    return d.withColumn("persistence_score", score).withColumn("label", persistence_label("persistence_score"))


def persistence_inputs(bars: DataFrame) -> DataFrame:
    """Per bar: momentum sub-score of RSI, MACD, band position and trend, 20-bar return, turnover, stability."""
    d = ind.rsi_wilder(ind.macd_events(ind.macd(bars)))
    d = ind.volume_over_earlier(ind.trend(d))
    d = d.select("*", mean_n("close", 20, 20).alias("_m"), ind.std_n("close", 20, 20).alias("_s"), nz(momentum(20)).alias("return_20d"),
                 F.row_number().over(series()).alias("n_bars"))
    bb = F.when(F.col("_s") * 4 < 1e-10, 50.0).otherwise(clip(div0(F.col("close") - F.col("_m") + F.col("_s") * 2, F.col("_s") * 4) * 100, 0, 100))
    td = (F.col("close") - F.col("_m")) / F.col("_m") * 100
    parts = (
        clip((nz("rsi_w", 50.0) - 50) / 5 + 5, 0, 10)
        + tiers([(F.col("macd_label") == "golden_cross", 8.0), (F.col("macd_label") == "death_cross", 2.0)], 5.0)
        + F.when(nz(bb, 50.0).between(30, 70), 8.0).otherwise(5.0)
        + tiers([(td > 2, 8.0), (td < -2, 3.0)], 5.0)
    )
    return d.withColumn("momentum_score", parts * 0.25).withColumn("stability_score", nz("trend_r2", 5.0))


def persistence(bars: DataFrame, weights: Mapping[str, float] = PERSISTENCE_WEIGHTS) -> DataFrame:
    """Newest persistence score per industry, labelled and ranked."""
    inputs = persistence_inputs(bars).select("code", "dt", "momentum_score", "return_20d", "turnover_ratio", "stability_score")
    d = latest_rows(inputs, min_rows=21)
    # one row per industry from here on: the whole-table window is bounded by the industry dimension
    every = Window.partitionBy()
    d = d.withColumn("_rel", F.col("return_20d") / (F.avg("return_20d").over(every) + 1e-10))
    scaled = {"slope_score": "return_20d", "turnover_score": "turnover_ratio", "relative_score": "_rel"}
    lo, hi = ({o: agg(x).over(every) for o, x in scaled.items()} for agg in (F.min, F.max))
    d = d.select("*", *[
        F.when(hi[o] - lo[o] < 1e-10, 5.0).otherwise(div0(F.col(x) - lo[o], hi[o] - lo[o]) * 10).alias(o) for o, x in scaled.items()
    ])
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    d = d.withColumn("persistence_score", F.round(total + 1e-6, 2)).withColumn("label", persistence_label("persistence_score"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("persistence_score"), "code")))


def top_divergence(d: DataFrame, n: int = 60) -> DataFrame:
    """Price near its n-bar peak while every histogram value after the peak is below the peak's (needs ``macd_hist``)."""
    w = Window.partitionBy("code").orderBy("dt").rowsBetween(-(n - 1), 0)
    bars = F.collect_list(F.struct("close", "macd_hist")).over(w)
    d = d.withColumn("_b", bars)
    peak = F.array_max(F.transform("_b", lambda x: x["close"]))
    pos = F.array_position(F.transform("_b", lambda x: x["close"]), peak)
    after = F.slice(F.col("_b"), pos.cast("int") + 1, F.lit(n))
    late = F.array_max(F.transform(after, lambda x: x["macd_hist"]))
    at = F.element_at(F.transform("_b", lambda x: x["macd_hist"]), pos.cast("int"))
    inside = (pos > 1) & (pos < F.size("_b"))
    return d.withColumn("divergence", nz(inside & (F.col("close") >= peak * 0.98) & (late < at), False)).drop("_b")


def price_levels(price: Column, atr: Column, above: Column) -> dict[str, Column]:
    """Entry range, stop, targets and reward:risk; the factors depend on the side of MA20."""
    a = F.when(price > 0, div0(atr, price)).otherwise(0.01)

    def level(up: float, down: float) -> Column:
        return F.round(price * (F.lit(1.0) + a * F.when(above, F.lit(up)).otherwise(F.lit(down))) + 1e-6, 2)

    entry_low, stop, t1, t2 = level(-0.5, -0.3), level(-1.5, -1.2), level(1.0, 0.8), level(2.0, 1.5)
    risk = price - stop
    return {
        "entry_low": entry_low,
        "entry_high": level(0.0, 0.2),
        "stop_loss": stop,
        "target_1": t1,
        "target_2": t2,
        "expected_return_t1": rd((t1 / price - 1) * 100, 1),
        "expected_return_t2": rd((t2 / price - 1) * 100, 1),
        "risk_pct": rd(risk / price * 100, 1),
        "reward_risk_t1": F.when(risk > 0, rd(div0(t1 - price, risk), 1)).otherwise(0.0),
    }


def zone_inputs(bars: DataFrame) -> DataFrame:
    d = ind.rsi_sma(top_divergence(ind.macd(bars)), (14,))
    d = d.select(
        "*",
        F.row_number().over(series()).alias("n_bars"), mean_n("close", 20, 20).alias("ma20"), mean_n("close", 60, 60).alias("ma60"),
        div0(mean_n("vol", 5), mean_n("vol", 20)).alias("vol_ratio"), momentum(5).alias("chg5"), momentum(20).alias("chg20"),
        ind.true_range().alias("_tr"), (F.col("high") - F.col("low")).alias("_rg"),
        lag("open", 1).alias("_o1"), lag("close", 1).alias("_c1"), lag("open", 2).alias("_o2"), lag("close", 2).alias("_c2"),
    )
    d = d.select("*", mean_n("_tr", 14, 14).alias("atr"), F.avg("_rg").over(before_n(20)).alias("_mr"))
    b2, b0 = F.abs(F.col("_c2") - F.col("_o2")), F.abs(F.col("close") - F.col("open"))
    solid = (b2 > 0) & (b0 > 0)
    star = solid & (F.col("_c2") > F.col("_o2")) & (b2 > F.col("_mr") * 0.6) & (F.abs(F.col("_c1") - F.col("_o1")) < b2 * 0.3) & (
        (F.col("close") < F.col("open")) & (F.col("close") < F.col("_c2") - b2 * 0.5)
    )
    cloud = solid & (F.col("_c2") > F.col("_o2")) & (F.col("open") > F.col("_c2")) & (F.col("close") < F.col("_o2") + (F.col("_c2") - F.col("_o2")) * 0.5)
    return d.select(
        *[x for x in d.columns if not x.startswith("_")], nz(star, False).alias("evening_star"), nz(cloud, False).alias("dark_cloud")
    ).withColumn("rsi_14", nz("rsi_14", 50.0))


def zones(bars: DataFrame, min_bars: int = 60) -> DataFrame:
    """Additive strength score of RSI, MACD, volume, averages and momentum, and the zone per bar."""
    d = zone_inputs(bars).where(F.col("n_bars") >= min_bars)
    rsi, dif, hist, chg = F.col("rsi_14"), F.col("macd_dif"), F.col("macd_hist"), F.col("chg20")
    top_candle = F.col("evening_star") | F.col("dark_cloud")
    shrink = (F.col("vol_ratio") < 0.8) & (F.col("chg5") > 0)
    swell = (F.col("vol_ratio") > 1.3) & (F.col("chg5") > 0)
    above20, above60 = F.col("close") > F.col("ma20"), F.col("close") > F.col("ma60")
    score = (
        tiers([(rsi > 70, -2), (rsi > 60, 2), (rsi > 50, 1), (rsi > 40, 0)], -1)
        + tiers([((dif > 0) & (hist > 0), 2), ((dif < 0) & (hist < 0), -2), ((dif > 0) & (hist < 0), -1)], 0)
        + F.when(F.col("divergence"), -3).otherwise(0)
        + F.when(top_candle, -3).otherwise(0)
        + tiers([(shrink, -1), (swell, 2)], 0)
        + F.when(above20 & above60, 2).otherwise(0)
        + tiers([(chg > 10, -1), (chg > 5, 3), (chg > 2, 1), (chg < -10, 1), (chg < -5, -2)], 0)
    )
    signals = present(
        tiers([(rsi > 70, "rsi_overbought"), (rsi > 60, "rsi_strong"), (rsi > 50, "rsi_firm"), (rsi > 40, "rsi_neutral"), (rsi > 30, "rsi_soft")], "rsi_oversold"),
        tiers([((dif > 0) & (hist > 0), "macd_bull"), ((dif < 0) & (hist < 0), "macd_bear"), ((dif > 0) & (hist < 0), "macd_fading")], None),
        F.when(F.col("divergence"), "divergence"),
        F.when(F.col("evening_star"), "evening_star").when(F.col("dark_cloud"), "dark_cloud"),
        tiers([(shrink, "volume_shrinks"), (swell, "volume_swells")], None),
        tiers([(chg > 10, "overheated"), (chg > 5, "strong_20d"), (chg > 2, "firm_20d"), (chg < -10, "oversold_20d"), (chg < -5, "weak_20d")], None),
    )
    d = d.select("*", score.alias("score"), top_candle.alias("top_candle"), signals.alias("signals"))
    bad = F.col("divergence") | F.col("top_candle")
    zone = tiers(
        [
            (rsi > 80, "top_warn"),
            ((F.col("score") >= 4) & ~bad, "chase"),
            ((F.col("score") <= -3) | bad, "top_warn"),
            ((F.col("score") <= -1) | (rsi < 40), "weak"),
        ],
        "watch",
    )
    return d.withColumn("zone", zone)


def zone_rules(d: DataFrame) -> DataFrame:
    """Threshold-study zone per bar from RSI, DIF and volume ratio (NULLs read as 0, 0 and fine)."""
    rsi, dif, vr = nz("rsi_14"), nz("macd_dif"), F.col("volume_ratio")
    zone = tiers(
        [
            ((rsi > 50) & (dif > 0) & (vr.isNull() | (vr >= 0.8)), "chase"),
            ((rsi > 50) & (dif > 0), "watch"),
            ((dif > 0) | (rsi > 45), "watch"),
            (rsi > 55, "top_warn"),
            (rsi < 30, "top_warn"),
        ],
        "weak",
    )
    return d.withColumn("zone", zone)


def study_zones(bars: DataFrame, min_bars: int = 60) -> DataFrame:
    """Zone and divergence of every bar as the threshold study takes them: MACD by adjusted smoothing, divergence of the last two
    price peaks against DIF, and an RSI that is unknown without a loss (which meets no condition)."""
    from .pullbacks import peak_divergence

    d = ind.rsi_sma(peak_divergence(ind.macd(bars, adjusted=True)), (14,))
    d = d.select("*", F.row_number().over(series()).alias("n_bars"), div0("vol", mean_n("vol", 20, 20)).alias("volume_ratio")).where(F.col("n_bars") >= min_bars)
    rsi, dif, vr = F.col("rsi_14"), nz("macd_dif"), F.col("volume_ratio")
    zone = tiers(
        [((rsi > 50) & (dif > 0) & (vr.isNull() | (vr >= 0.8)), "chase"), ((dif > 0) | (rsi > 45), "watch"), (rsi > 55, "top_warn"), (rsi < 30, "top_warn")], "weak"
    )
    return d.withColumns({"zone": zone, "divergence": F.col("peak_divergence")}).drop("peak_divergence")


def zone_counts(d: DataFrame) -> DataFrame:
    """Zones per date and the risk level they imply."""
    kinds = ("chase", "watch", "top_warn", "weak")
    agg = d.groupBy("dt").agg(
        *[F.sum(one_if(F.col("zone") == z)).alias(z) for z in kinds], F.sum(one_if(F.col("divergence"))).alias("divergence")
    )
    return agg.withColumn("risk_level", tiers([(F.col("divergence") >= 4, "critical"), (F.col("top_warn") >= 16, "high")], "normal"))


def hierarchy_momentum(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.select("code", "dt", momentum(n).alias("ind_mom"))


def closure(parents: DataFrame, leaves: DataFrame, deepest: int = 16) -> DataFrame:
    """(code, depth, group): every group above each leaf. ``parents`` has child and parent, ``leaves`` has code and parent; depth 1 is
    the group of the leaf itself, growing upwards. A tree of more than ``deepest`` levels, or with a cycle, is an error."""
    level = leaves.select("code", F.col("parent").alias("group")).where("group is not null").withColumn("depth", F.lit(1))
    out = level
    for depth in range(2, deepest + 2):
        up = parents.where("parent is not null").select(F.col("child").alias("group"), F.col("parent").alias("_up"))
        level = level.join(up, "group").select("code", F.col("_up").alias("group"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            return out.select("code", "depth", "group")
        if depth > deepest:
            break
        out = out.unionByName(level)
    raise ValueError(f"more than {deepest} levels, or a group above itself")


def hierarchy_levels(features: DataFrame, above: DataFrame, group_bars: DataFrame, market: DataFrame, n: int = 20) -> DataFrame:
    """Momentum (``mom20`` of ``features``) against every level of a hierarchy of any depth, a row per (code, dt, level).

    ``above`` is a ``closure``; levels are numbered from the top, 1 being the highest. ``group_bars`` has the bars of all groups
    (``code`` is the group). ``excess_return`` is against the level's group, ``divergence`` the group's momentum less that of the level
    above it (NULL at the top), ``agreeing`` how many levels move the instrument's way. A missing group day counts as 0; instruments
    without any group have one row of level 0, against the market."""
    moves = hierarchy_momentum(group_bars, n).select(F.col("code").alias("group"), "dt", nz("ind_mom").alias("_g"))
    top = above.groupBy("code").agg(F.max("depth").alias("_top"))
    levels = above.join(top, "code").select("code", "group", (F.col("_top") - F.col("depth") + 1).alias("level"))
    d = features.join(levels, "code", "left").join(moves, ["group", "dt"], "left")
    mk = hierarchy_momentum(market, n).select("dt", nz("ind_mom").alias("_mk"))
    d = d.join(mk, "dt", "left").withColumn("level", nz("level", 0)).withColumn("_g", nz(F.when(F.col("level") == 0, F.col("_mk")).otherwise(F.col("_g"))))
    m = nz("mom20")
    one = Window.partitionBy("code", "dt")  # a row per level
    agree = F.sum(one_if((F.signum("_g") == F.signum(m)) & (F.signum(m) != 0))).over(one)
    return d.select(
        "code", "dt", F.col("level").cast("int").alias("level"), "group", (m - F.col("_g")).alias("excess_return"), (F.col("_g") - F.lag("_g").over(one.orderBy("level"))).alias("divergence"), agree.alias("agreeing")
    )


def hierarchy_features(features: DataFrame, members: DataFrame, l1_bars: DataFrame, l2_bars: DataFrame, market: DataFrame) -> DataFrame:
    """Excess momentum against both industry levels and their agreement; an unmapped
    instrument is measured against the market, a missing industry day counts as 0."""
    mk = hierarchy_momentum(market).select("dt", F.col("ind_mom").alias("_mk"))
    d = features.join(members.select("code", "l1", "l2"), "code", "left")
    for level, bars in (("l1", l1_bars), ("l2", l2_bars)):
        h = hierarchy_momentum(bars).select(F.col("code").alias(level), "dt", F.col("ind_mom").alias(f"_{level}"))
        d = d.join(h, [level, "dt"], "left")
    d = d.join(mk, "dt", "left")
    own = {k: nz(F.when(F.col(k).isNull(), F.col("_mk")).otherwise(F.col(f"_{k}"))) for k in ("l1", "l2")}
    m = nz("mom20")
    signs = [F.signum(m), F.signum(own["l2"]), F.signum(own["l1"])]
    agree = sum((one_if((s == signs[0]) & (s != 0)) for s in signs), F.lit(0))
    return d.select(
        *features.columns,
        (m - own["l1"]).alias("excess_return_l1"),
        (m - own["l2"]).alias("excess_return_l2"),
        (own["l2"] - own["l1"]).alias("L2_L1_divergence"),
        F.when(signs[0] == 0, 2.0).otherwise(agree.cast("double")).alias("industry_cascade"),
    )

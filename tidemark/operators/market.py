"""Date-level market series: index, breadth, regime, fragility, sentiment.

All inputs are first aggregated to one row per date, so the windows over the date order
work on a table bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import span_rate, with_ewm
from ..functions.ranks import exact_percentiles, with_rank_columns
from ..functions.scalar import div0, exact_avg, exact_sum, flag, nz, one_if, safe_div, tiers
from ..functions.windows import lag, mean_n, momentum, series, std_n, sum_n
from .indicators import adx

# Fixed thresholds of the fragility rules (percent of industries falling, days of five).
HEAVY_DOWN, HEAVY_DAYS = 70, 3
STRICT_DOWN, STRICT_DAYS = 75, 4
BOUNCE_DOWN, MICRO_DOWN, MICRO_DAYS, REENTRY_DOWN = 60, 70, 3, 30
MARKET = "MKT"


def market_index(bars: DataFrame) -> DataFrame:
    """Equal-weight levels per date; ``code`` is one constant market code."""
    return bars.groupBy("dt").agg(
        F.avg("close").alias("close"),
        F.avg("high").alias("high"),
        F.avg("low").alias("low"),
        F.sum("vol").alias("vol"),
        F.sum("amount").alias("amount"),
        F.count(F.lit(1)).alias("n_members"),
    ).withColumn("code", F.lit(MARKET))


def market_return_index(panel: DataFrame, base: float = 1000.0) -> DataFrame:
    """Compounded mean return, rebased to ``base`` on the first date."""
    daily = panel.groupBy("dt").agg((F.avg("pct_chg") / 100).alias("ret")).withColumn("ret", nz("ret"))
    w = Window.orderBy("dt")
    level = F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = daily.withColumn("_lv", level)
    return d.select("dt", "ret", (F.col("_lv") * base / F.first("_lv").over(w)).alias("index_close"))


def breadth(panel: DataFrame) -> DataFrame:
    """Share of members falling; a member without a previous bar counts in the denominator."""
    return panel.groupBy("dt").agg(
        (F.sum(one_if(F.col("pct_chg") < 0)) / F.count(F.lit(1)) * 100).alias("down_pct"),
        F.count(F.lit(1)).alias("n_members"),
    )


def breadth_features(panel: DataFrame) -> DataFrame:
    up, dn = F.sum(one_if(F.col("pct_chg") > 0)), F.sum(one_if(F.col("pct_chg") < 0))
    d = panel.groupBy("dt").agg(
        up.alias("_up"), dn.alias("_dn"), F.count(F.lit(1)).alias("_n"),
        F.avg("pct_chg").alias("market_regime_score"),
        F.sum(one_if(F.col("pct_chg") > 2) - one_if(F.col("pct_chg") < -2)).cast("double").alias("bull_bear_power"),
    )
    extreme = (F.col("_up") > F.col("_n") * 0.8) | (F.col("_dn") > F.col("_n") * 0.8)
    return d.select(
        "dt",
        safe_div(F.col("_up").cast("double"), F.col("_dn")).alias("advance_decline_ratio"),
        F.col("_up").cast("double").alias("total_up_days"),
        flag(extreme).alias("market_extreme_signal"),
        nz("market_regime_score").alias("market_regime_score"),
        "bull_bear_power",
    )


def turnover(panel: DataFrame, valuation: DataFrame) -> DataFrame:
    """Turnover level per date: mean and median of vol over size, sums, median PE, count."""
    d = panel.join(
        valuation.select("code", F.col("dt").alias("_m"), "total_mv", "pe_ttm"),
        (panel.code == valuation.code) & (F.trunc(panel.dt, "month").cast("date") == F.col("_m")),
    ).select("dt", (F.col("amount") / F.col("total_mv") * 100).alias("turnover"), "total_mv", "amount", "pe_ttm")
    sums = d.groupBy("dt").agg(
        exact_avg("turnover").alias("avg_turnover"), F.sum("total_mv").alias("total_mv"),
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("n_codes"),
    )
    med = exact_percentiles(d, ["dt"], "turnover", {"median_turnover": 0.5})
    pe = exact_percentiles(d, ["dt"], "pe_ttm", {"median_pe": 0.5})
    return sums.join(med, "dt", "left").join(pe, "dt", "left")


def margin_totals(margin: DataFrame) -> DataFrame:
    """Market balance, purchases and repayments per date with 1- and 3-date changes."""
    daily = margin.groupBy("dt").agg(*[exact_sum(k).alias(k) for k in ("rzye", "rzmre", "rzche")])
    w = Window.orderBy("dt")
    return daily.select(
        "*",
        (F.col("rzmre") - F.col("rzche")).alias("net_buy"),
        (div0(F.col("rzye") - lag("rzye", 1, w), F.abs(lag("rzye", 1, w))) * 100).alias("rzye_chg_1d"),
        (div0(F.col("rzye") - lag("rzye", 3, w), F.abs(lag("rzye", 3, w))) * 100).alias("rzye_chg_3d"),
    )


def history_percentile(df: DataFrame, x: str, out: str, min_rows: int = 50) -> DataFrame:
    """Share of the column's history at or below each value; 50 with too short a history."""
    share = F.when(F.col("n_group") > min_rows, (F.col("n_below") + F.col("n_tie")) / F.col("n_group") * 100).otherwise(50.0)
    return with_rank_columns(df, [], x, **{out: share})


def sentiment(margin_daily: DataFrame, turnover_daily: DataFrame) -> DataFrame:
    """Leverage and turnover percentiles against their history and the joint mood per date."""
    lev = history_percentile(margin_daily, "rzye_chg_3d", "leverage_pct").select("dt", "rzye_chg_3d", "leverage_pct")
    tov = history_percentile(turnover_daily, "avg_turnover", "turnover_pct").select("dt", "avg_turnover", "turnover_pct")
    d = lev.join(tov, "dt", "full").select(
        "dt", "rzye_chg_3d", "avg_turnover",
        F.round(nz("leverage_pct", 50.0)).alias("leverage_pct"), F.round(nz("turnover_pct", 50.0)).alias("turnover_pct"),
    )
    lp, tp = F.col("leverage_pct"), F.col("turnover_pct")
    extreme = one_if(lp >= 90) + one_if(tp >= 90)
    return d.select(
        "*",
        tiers([(F.col("rzye_chg_3d") < -1, "deleveraging"), (F.col("rzye_chg_3d") > 1, "leveraging"),
               (F.col("rzye_chg_3d").isNotNull(), "steady")], "unknown").alias("leverage_signal"),
        tiers([(tp >= 80, "high"), (tp <= 20, "low")], "normal").alias("turnover_signal"),
        tiers([(extreme >= 2, "extreme"), (extreme >= 1, "elevated"), ((lp <= 20) & (tp <= 20), "cold")], "normal").alias("mood"),
    )


# Fixed values of the regime parameters.
REGIMES = ("bull", "early_bull", "rebound", "range_up", "pullback", "range_down", "bear")
NORMALISED = {
    "bull": "bull", "early_bull": "bull", "rebound": "range", "range": "range", "range_up": "range",
    "range_down": "range", "pullback": "range", "bear": "bear",
}


def regimes(index: DataFrame, fast: int = 50, slow: int = 200, adx_n: int = 14, strong: float = 25.0) -> DataFrame:
    """Three-state and seven-state market regime for every date in one pass."""
    d = index.select(
        "code", "dt", "close", "high", "low",
        mean_n("close", fast, fast).alias("ma50"), mean_n("close", slow, slow).alias("ma200"),
        mean_n("close", 20, 20).alias("ma20"),
        nz(momentum(20)).alias("ret20"), nz(momentum(60)).alias("ret60"), F.row_number().over(series()).alias("_n"),
    )
    d = adx(d, adx_n)
    px, above = F.col("close"), F.col("close") > F.col("ma200")
    known = F.col("_n") > slow
    trend = F.col("adx") >= strong
    base = tiers([(~known, "RANGE"), (trend & above, "BULL"), (trend & ~above, "BEAR")], "RANGE")
    d = d.withColumn("regime", base)
    above20 = nz(F.col("close") > F.col("ma20"), False)
    fine = tiers(
        [
            ((F.col("regime") == "BEAR") & (F.col("ret20") < -5), "bear"),
            ((F.col("regime") == "BULL") & (F.col("ret20") > 5) & (F.col("ret60") > 10), "bull"),
            ((F.col("regime") == "BULL") & (F.col("ret20") > 3), "early_bull"),
            (above20 & (F.col("ret20") > 2), "rebound"),
            (above20, "range_up"),
            (above, "pullback"),
        ],
        "range_down",
    )
    return d.select("dt", px.alias("price"), "ma50", "ma200", "adx", "ret20", "ret60", "regime", F.when(known, fine).alias("regime_v2"))


def normalised_regime(label: Column) -> Column:
    """bull / range / bear of any label; unknown labels count as range."""
    key = F.lower(F.trim(label))
    return tiers([(key == k, v) for k, v in NORMALISED.items() if v != "range"], "range")


def up_ema_regimes(index: DataFrame) -> DataFrame:
    """Regime of the persistence study: twice-smoothed share of up days against 25, price against MA200."""
    d = index.select(
        "code", "dt", "close",
        F.when(F.count("close").over(series().rowsBetween(-199, 0)) >= 120, F.avg("close").over(series().rowsBetween(-199, 0))).alias("ma200"),
        flag(F.col("close") > lag("close")).alias("_up"),
    )
    d = with_ewm(d, {"_e1": ("_up", span_rate(14))})
    d = with_ewm(d, {"_e2": ("_e1", span_rate(14))})
    above, strong = nz(F.col("close") > F.col("ma200"), True), F.col("_e2") * 100 >= 25
    label = tiers([(strong & above, "BULL"), (strong & ~above, "BEAR")], "RANGE")
    return d.select("dt", "close", "ma200", (F.col("_e2") * 100).alias("up_ema"), label.alias("regime"))


def dashboard(index: DataFrame, members: DataFrame, top: int = 3) -> DataFrame:
    """Index changes, MA200 flag, breadth above MA20 and share up over five bars, per date."""
    idx = index.select(
        "dt", F.col("close").alias("index_close"), momentum(5).alias("chg5"), momentum(20).alias("chg20"), momentum(60).alias("chg60"),
        (F.col("close") > mean_n("close", 200, 200)).alias("above_ma200"),
    )
    m = members.select("dt", "code", (F.col("close") > mean_n("close", 20, 20)).alias("_a"), (momentum(5) > 0).alias("_u"))
    share = m.groupBy("dt").agg(
        (div0(F.sum(one_if(F.col("_a"))).cast("double"), F.count("_a")) * 100).alias("above_ma20_pct"),
        (div0(F.sum(one_if(F.col("_u"))).cast("double"), F.count("_u")) * 100).alias("up_5d_pct"),
    )
    return idx.join(share, "dt", "left")


def extremes_by_date(panel: DataFrame, x: str = "pct_chg", top: int = 3) -> DataFrame:
    """Top and bottom ``top`` members per date by x (ties by code)."""
    d = panel.where(F.col(x).isNotNull())
    hi = d.withColumn("rk", F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(x), "code"))).where(F.col("rk") <= top)
    lo = d.withColumn("rk", F.row_number().over(Window.partitionBy("dt").orderBy(F.asc(x), "code"))).where(F.col("rk") <= top)
    cols = ["dt", "code", x, "rk"]
    return hi.select(*cols, F.lit("top").alias("side")).unionByName(lo.select(*cols, F.lit("bottom").alias("side")))


def fragility(index: DataFrame, industry_breadth: DataFrame, micro_breadth: DataFrame) -> DataFrame:
    """Breadth collapse, trend break, weak bounce and micro-cap rules with level and position cap."""
    w = Window.orderBy("dt")
    five = w.rowsBetween(-4, 0)
    mic = micro_breadth.select("dt", F.col("down_pct").alias("micro_down"))
    d = index.select(
        "dt", F.col("close").alias("price"), momentum(1).alias("chg"), "vol",
        mean_n("close", 20, 20).alias("ma20"), mean_n("vol", 20, 20).alias("vma20"),
    ).join(industry_breadth.select("dt", "down_pct"), "dt").join(mic, "dt", "left")
    full = F.count(F.lit(1)).over(five) >= 5
    heavy = F.sum(one_if(F.col("down_pct") > HEAVY_DOWN)).over(five)
    strict = F.sum(one_if(F.col("down_pct") > STRICT_DOWN)).over(five)
    micro = F.sum(one_if(F.col("micro_down") > MICRO_DOWN)).over(five)
    d = d.select(
        "*",
        heavy.alias("heavy_days"),
        nz(full & (heavy >= HEAVY_DAYS), False).alias("p1"),
        nz(full & (strict >= STRICT_DAYS), False).alias("p1_strict"),
        nz(F.col("price") < F.col("ma20"), False).alias("p2"),
        nz((F.col("chg") > 0) & (F.col("down_pct") > BOUNCE_DOWN) & (F.col("vol") < F.col("vma20")), False).alias("p3"),
        nz(full & (micro >= MICRO_DAYS), False).alias("micro_p1"),
    )
    p1, st, p2, p3, mi = (F.col(x) for x in ("p1", "p1_strict", "p2", "p3", "micro_p1"))
    level = tiers([(st | (p1 & p2) | (p1 & mi), "danger"), (p1 | (p2 & p3), "warning"), (p3 | mi, "caution")], "normal")
    cap = tiers([(st | (p1 & p2) | (p1 & mi), 15), (p1 | (p2 & p3), 30), (p3 | mi, 40)], 100)
    return d.select(
        "dt", "down_pct", "heavy_days", "p1", "p1_strict", "p2", "p3", "micro_p1", level.alias("alert_level"), cap.alias("pos_cap"),
        (F.col("down_pct") <= REENTRY_DOWN).alias("re_entry"),
    )


def risk_features(index: DataFrame, industries: DataFrame) -> DataFrame:
    """Breadth, MA20 share, volatility expansion, amount shock, deviation and median RSI per date."""
    from .indicators import rsi_sma

    d = rsi_sma(industries, (14,)).select(
        "dt", "code", "rsi_14", (F.col("close") / lag("close") - 1).alias("_r"), (F.col("close") > mean_n("close", 20, 20)).alias("_a"),
    )
    agg = d.groupBy("dt").agg(
        div0(F.sum(one_if(F.col("_r") > 0)).cast("double"), F.count("_r")).alias("breadth_ratio"),
        div0(F.sum(one_if(F.col("_a"))).cast("double"), F.count("_a")).alias("ma20_ratio"),
    )
    med = exact_percentiles(d, ["dt"], "rsi_14", {"rsi_median": 0.5})
    i = index.withColumn("_ret", F.col("close") / lag("close") - 1)
    i = i.select(
        "dt", "close", "code",
        div0(std_n("_ret", 5, 5), std_n("_ret", 20, 20)).alias("vol_expansion"),
        div0("amount", mean_n("amount", 20, 20)).alias("volume_shock"),
        ((F.col("close") / mean_n("close", 20, 20) - 1) * 100).alias("index_deviation"),
    )
    return i.join(agg, "dt", "left").join(med, "dt", "left")


def minmax_score(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of columns scaled to 0..1 over a one-row-per-date table."""
    every = Window.partitionBy()
    terms = []
    for k, w in weights.items():
        lo, hi = F.min(k).over(every), F.max(k).over(every)
        terms.append(nz(div0(F.col(k) - lo, hi - lo)) * w)
    return df.withColumn(out, sum(terms[1:], terms[0]))


def warning_signals(index: DataFrame, industry_breadth: DataFrame) -> DataFrame:
    """First-trigger edges of the three warning phases per date."""
    w = Window.orderBy("dt")
    d = index.select(
        "dt", "close", momentum(1).alias("chg"), momentum(5).alias("ret5"), momentum(10).alias("ret10"),
        nz(F.col("close") < mean_n("close", 20, 20), False).alias("below"), nz(F.col("vol") < mean_n("vol", 20, 20), False).alias("thin"),
    ).join(industry_breadth.select("dt", "down_pct"), "dt")
    five = w.rowsBetween(-4, 0)
    collapse = (F.count(F.lit(1)).over(five) >= 5) & (F.sum(one_if(F.col("down_pct") > HEAVY_DOWN)).over(five) >= HEAVY_DAYS)
    d = d.withColumn("collapse", collapse).withColumn("_i", F.row_number().over(w) - 1)
    d = d.select(
        "*",
        ((F.col("_i") >= 5) & F.col("collapse") & ~nz(lag("collapse", 1, w), False)).alias("phase1"),
        ((F.col("_i") >= 20) & F.col("below") & ~nz(lag("below", 1, w), False)).alias("phase2"),
        nz((F.col("chg") > 0) & (F.col("down_pct") > BOUNCE_DOWN) & F.col("thin"), False).alias("phase3"),
    )
    level = tiers([(F.col("phase3"), "danger"), (F.col("phase2"), "warning"), (F.col("phase1"), "caution")], "normal")
    return d.withColumn("alert_level", level).drop("_i", "collapse")


def market_allows(index: DataFrame, industry_breadth: DataFrame, indicator: str, threshold: float) -> DataFrame:
    """Dates on which a market indicator is at or above the threshold."""
    d = index.select(
        "dt", momentum(5).alias("idx5"), momentum(20).alias("idx20"), momentum(60).alias("idx60"),
        ((F.col("close") / mean_n("close", 200, 200) - 1) * 100).alias("ma200"),
    ).join(industry_breadth.select("dt", (F.lit(100.0) - F.col("down_pct")).alias("breadth")), "dt")
    return d.where(F.col(indicator) >= threshold)


def ts_percentile(df: DataFrame, x: str, out: str, n: int = 250, min_rows: int = 60, key: str | None = None) -> DataFrame:
    """Percentile of the newest value inside its own trailing window (share at or below)."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("dt").rowsBetween(-(n - 1), 0)
    d = df.withColumn("_h", F.collect_list(x).over(w))
    share = F.size(F.filter("_h", lambda v: v <= F.col(x))) / F.size("_h") * 100
    return d.withColumn(out, F.when((F.size("_h") >= min_rows) & F.col(x).isNotNull(), share)).drop("_h")


def mood_summary(newest: DataFrame, x: str, strong: float = 5.0, side: float = 3.0) -> DataFrame:
    """Mean momentum over industries, counts on each side, and the mood label."""
    agg = newest.agg(
        F.avg(x).alias("avg_momentum"), F.sum(one_if(F.col(x) > side)).alias("bullish_count"), F.sum(one_if(F.col(x) < -side)).alias("bearish_count"),
        F.sum(one_if(F.col(x).between(-side, side))).alias("neutral_count"),
    )
    return agg.withColumn("mood", tiers([(F.col("avg_momentum") > strong, "bullish"), (F.col("avg_momentum") < -strong, "bearish")], "neutral"))

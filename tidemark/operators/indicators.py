"""Technical indicators per instrument, as window expressions.

Every function takes bars (code, dt, open, high, low, close, vol, amount[, pre_close,
pct_chg]) and returns them with further columns. All windows share one specification, so
stacked calls cost one shuffle by code and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import span_rate, wilder_rate, with_ewm, with_ewm_adjusted, with_ewm_stages
from ..functions.scalar import clip, corr, div0, flag, nz, one_if, tiers
from ..functions.windows import (
    before_n, kurtosis, lag, last_n, lead, max_n, mean_n, min_n, momentum, next_n, power_means, roll, series, skewness, std_n, sum_n, upto,
)

YEAR_DAYS = 252
MOMENTUM_STEPS = (1, 2, 3, 4, 5, 7, 10, 12, 15, 20, 30, 45, 60, 75, 90, 120)


def momenta(bars: DataFrame, steps=MOMENTUM_STEPS) -> DataFrame:
    return bars.select("*", *[momentum(n).alias(f"mom{n}") for n in steps])


def daily_return(bars: DataFrame) -> DataFrame:
    """``ret``: percent change, 0 on the first bar."""
    return bars.withColumn("ret", nz(momentum(1)))


def moving_averages(bars: DataFrame, steps=(5, 10, 20, 60, 120, 250), full: bool = False) -> DataFrame:
    """Averages and percent deviations; ``full`` keeps NULL until the window is filled."""
    d = bars.select("*", *[mean_n("close", n, n if full else 1).alias(f"ma{n}") for n in steps])
    return d.select("*", *[((F.col("close") / F.col(f"ma{n}") - 1) * 100).alias(f"ma{n}_dev") for n in steps])


def _order(a: str, b: str) -> Column:
    return one_if(F.col(a) > F.col(b)) - one_if(F.col(a) < F.col(b))


def ma_order(d: DataFrame) -> DataFrame:
    """Cross flag, ordering score 0..4 and gap of the averages from ``moving_averages``."""
    score = _order("ma5", "ma10") + _order("ma10", "ma20") + _order("ma20", "ma60")
    return d.select(
        "*",
        flag(F.col("ma5") > F.col("ma20")).alias("ma_cross"),
        clip(score + 2, 0, 4).alias("ma_arrangement"),
        ((F.col("ma5") - F.col("ma20")) / F.col("close") * 100).alias("ma_gap"),
    )


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, min_rows: int = 5) -> DataFrame:
    """Band position %B (50 when flat), relative width, and the band lines themselves."""
    d = bars.select("*", mean_n("close", n, min_rows).alias("bb_mid"), std_n("close", n, min_rows).alias("bb_std"))
    mid, sd = F.col("bb_mid"), F.col("bb_std")
    return d.select(
        "*",
        (mid + sd * k).alias("bb_upper"),
        (mid - sd * k).alias("bb_lower"),
        nz(div0(F.col("close") - (mid - sd * k), sd * 2 * k) * 100, 50.0).alias("bb_pct_b"),
        F.when(mid > 0, sd * k / mid * 100).otherwise(0.0).alias("bb_width"),
    )


def bollinger_events(bars: DataFrame, n: int = 20) -> DataFrame:
    """Band crossings, squeeze against the 60-bar mean width, and days inside the bands of 5."""
    d = bars.select("*", mean_n("close", n, n).alias("_m"), std_n("close", n, n).alias("_s"))
    up, lo = F.col("_m") + F.col("_s") * 2, F.col("_m") - F.col("_s") * 2
    d = d.select(
        "*",
        flag(F.col("close") > up).alias("bb_cross_upper"),
        flag(F.col("close") < lo).alias("bb_cross_lower"),
        (div0(F.col("_s") * 2, "_m") * 100).alias("_w"),
        flag((F.col("close") >= lo) & (F.col("close") <= up)).alias("_in"),
    )
    d = d.select(
        "*",
        flag(F.col("_w") < mean_n("_w", 60, 60) * 0.5).alias("bb_squeeze_flag"),
        sum_n("_in", 5).alias("inside_bb_days"),
    )
    return d.drop("_m", "_s", "_w", "_in")


def volume_family(bars: DataFrame) -> DataFrame:
    d = bars.select(
        "*",
        mean_n("vol", 5).alias("vma5"), mean_n("vol", 20).alias("vma20"),
        mean_n("amount", 5).alias("ama5"), mean_n("amount", 20).alias("ama20"), mean_n("amount", 10).alias("ama10"),
        std_n("vol", 20, 5).alias("_vs20"), lag("vol").alias("_v1"),
    )
    d = d.select(
        "*",
        nz(div0("vol", "vma20")).alias("vol_ratio"),
        nz(div0("vol", "vma5")).alias("vol_ma5_ratio"),
        nz(F.col("vol") / F.col("_v1"), 1.0).alias("vol_shock"),
        nz(div0(F.col("vma5") - F.col("vma20"), "vma20")).alias("volume_oscillator"),
        nz(div0("amount", "ama20")).alias("amount_ratio"),
        nz(div0("ama5", "ama20")).alias("amount_trend"),
        nz(div0("vma5", "vma20")).alias("turnover_ratio_5d_20d"),
        nz(div0("_vs20", "vma20")).alias("turnover_std_20d"),
        div0("amount", "ama10").alias("amount_ma10_ratio"),
        flag(F.col("vol") > F.col("vma20") * 1.5).alias("_shock"),
    )
    return d.select(
        "*",
        sum_n("_shock", 5).alias("vol_shock_count_5d"),
        (F.col("volume_oscillator") - lag("volume_oscillator")).alias("volume_oscillator_accel"),
        flag((F.col("vol") < F.col("vma20") * 0.5) & (F.col("volume_oscillator") < -0.3)).alias("volume_dry_up_flag"),
    ).drop("_vs20", "_v1", "_shock")


# Fixed thresholds of the volume spike rules.
SPIKE_BREAKOUT, SPIKE_SHRINK, SPIKE_FULL = 1.5, 0.7, 3.0


def volume_spike(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over its n-bar mean, flags above 1.5 / below 0.7, and the newest-bar tag."""
    spike = nz(F.round(div0("vol", mean_n("vol", n)), 4), 1.0)
    newest = F.col("dt") == F.max("dt").over(Window.partitionBy("code"))
    d = bars.select("*", spike.alias("vol_spike"), newest.alias("is_snapshot"))
    return d.select(
        "*",
        (F.col("vol_spike") > SPIKE_BREAKOUT).alias("is_breakout"),
        (F.col("vol_spike") < SPIKE_SHRINK).alias("is_shrink"),
    )


def true_range(first_bar_range: bool = True, w=None) -> Column:
    """Largest of the three spans. The first bar has only high-low; the other convention is NULL."""
    pc = lag("close", 1, w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return tr if first_bar_range else F.when(pc.isNotNull(), tr)


def atr_sma(bars: DataFrame, n: int = 14, min_rows: int = 1, first_bar_range: bool = False) -> DataFrame:
    d = bars.withColumn("tr", true_range(first_bar_range))
    return d.withColumn("atr", mean_n("tr", n, min_rows)).withColumn("atr_pct", nz(F.col("atr") / F.col("close") * 100))


def atr_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    return with_ewm(bars.withColumn("tr", true_range()), {"atr_w": ("tr", wilder_rate(n))})


def bar_shape(bars: DataFrame) -> DataFrame:
    rng = F.col("high") - F.col("low")
    pos = div0(F.col("close") - F.col("open"), rng)
    return bars.select(
        "*",
        nz(div0(F.col("close") - F.col("low"), rng), 0.5).alias("close_position"),
        nz(rng / F.col("close") * 100).alias("daily_range"),
        (nz(F.col("open") / lag("close") - 1) * 100).alias("gap_pct"),
        (div0(F.col("high") - F.col("close"), "close") * 100).alias("high_vs_close_spread"),
        (div0(F.col("low") - F.col("close"), "close") * 100).alias("low_vs_close_spread"),
        pos.alias("open_position_ratio"),
        (div0(F.abs(F.col("close") - F.col("open")), rng) * 100).alias("body_to_range_ratio"),
    ).withColumn("open_position_accel", F.col("open_position_ratio") - lag("open_position_ratio"))


def return_stats(d: DataFrame, n: int = 20) -> DataFrame:
    """Rolling statistics of ``ret``; conditional means and deviations use NULL for the other side.

    The window aggregates are columns first: in a longer expression each would be evaluated as often as it is named."""
    up, dn = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") < 0, F.col("ret"))
    f = last_n(n)
    aggs = dict(zip(("_m", "_e1", "_e2", "_e3", "_e4"), power_means("ret", n))) | {
        "_sd": F.stddev_samp("ret").over(f), "_up": F.avg(up).over(f), "_dn": F.avg(dn).over(f), "_n_dn": F.count(dn).over(f),
        "_sd_dn": F.stddev_samp(dn).over(f), "_zero": F.sum(one_if(F.abs(F.col("ret")) < 0.01)).over(f),
    }
    m, mu, *_ = means = [F.col(k) for k in ("_m", "_e1", "_e2", "_e3", "_e4")]
    sd = F.col("_sd")
    enough, two = m >= 5, m >= 2
    up_mean, dn_mean = nz("_up"), F.abs(nz("_dn", 1.0))
    return d.select("*", *[a.alias(k) for k, a in aggs.items()]).select(
        *[F.col(k) for k in d.columns],
        F.when(enough & (sd > 1e-10), div0(mu, sd) * F.sqrt(F.lit(float(YEAR_DAYS)))).otherwise(0.0).alias("sharpe_20d"),
        skewness(means, 5).alias("skewness_20d"),
        kurtosis(means, 5).alias("kurtosis_20d"),
        F.when(enough, F.when(F.col("_n_dn") > 1, F.col("_sd_dn")).otherwise(0.0)).alias("downside_vol"),
        F.when(two & (dn_mean > 0.01), div0(up_mean, dn_mean)).otherwise(0.0).alias("upside_downside_ratio"),
        F.col("_zero").cast("double").alias("zero_return_days_20d"),
    )


def max_drawdown_n(x: str = "close", n: int = 20, min_rows: int = 5) -> Column:
    """Deepest fall from the running peak inside the window, percent."""
    frame = last_n(n)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))
    fold = F.aggregate(
        F.collect_list(x).over(frame),
        start,
        lambda a, v: F.struct(
            F.greatest(a["peak"], v).alias("peak"), F.least(a["dd"], v / F.greatest(a["peak"], v) - 1).alias("dd")
        ),
        lambda a: a["dd"] * 100,
    )
    return F.when(F.count(x).over(frame) >= min_rows, fold)


def realised_vol(bars: DataFrame) -> DataFrame:
    """Short volatilities of pct_chg and their place in the 60-bar history."""
    d = bars.select(
        "*",
        std_n("pct_chg", 5).alias("realized_vol_5d"), std_n("pct_chg", 10).alias("realized_vol_10d"),
        std_n("pct_chg", 14, 14).alias("vol14"), (std_n("pct_chg", 20, 20) * F.sqrt(F.lit(252.0))).alias("vol20_annual"),
    )
    d = d.select(
        "*", mean_n("vol14", 60, 60).alias("_m"), std_n("vol14", 60, 60).alias("_s"),
        (F.col("vol14") - lag("vol14")).alias("_d"),
    )
    return d.select(
        "*",
        div0(F.col("vol14") - F.col("_m"), "_s").alias("vol_surprise"),
        (F.col("_d") - lag("_d")).alias("vol_change_acceleration"),
        div0("vol14", "_m").alias("vol_regime_adaptive_ma"),
    ).drop("_m", "_s", "_d")


def price_position(n: int) -> Column:
    lo, hi = min_n("close", n), max_n("close", n)
    return nz(div0(F.col("close") - lo, hi - lo) * 100, 50.0)


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    """Deviation from the amount-weighted price, and the day's average-price proxy."""
    weighted = F.col("close") * F.col("amount")
    line = div0(F.sum(weighted).over(last_n(n)), F.sum("amount").over(last_n(n)))
    d = bars.select(
        "*",
        nz((F.col("close") / line - 1) * 100).alias("vwap_deviation"),
        (F.col("amount") / (F.col("vol") * 100 + 1e-10)).alias("intraday_vwap_proxy"),
    )
    return d.select(
        "*",
        ((F.col("close") / F.col("intraday_vwap_proxy") - 1) * 100).alias("close_vs_intraday_ratio"),
        ((F.col("open") / F.col("intraday_vwap_proxy") - 1) * 100).alias("open_vs_intraday_ratio"),
    )


def candles(bars: DataFrame) -> DataFrame:
    """One- to three-bar candle patterns as 0/1 columns, plus the upper shadow share."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    back = {f"{x}{k}": lag(x, k) for k in (1, 2, 3) for x in ("open", "close")}
    d = bars.select("*", *[e.alias(f"_{n}") for n, e in back.items()], F.avg("close").over(last_n(21)).alias("_avg"))
    o1, c1, o2, c2, c3 = (F.col(f"_{n}") for n in ("open1", "close1", "open2", "close2", "close3"))
    rng, body = h - l, F.abs(c - o)
    us, ls = h - F.greatest(c, o), F.least(c, o) - l
    solid = (rng > 0) & (body > 0)
    b1, b2 = F.abs(c1 - o1), F.abs(c2 - o2)
    rising = (c2 > o2) & (c1 > o1) & (c > o) & (c1 > c2) & (c > c1) & (c3.isNull() | (c2 > c3))
    falling = (c2 < o2) & (c1 < o1) & (c < o) & (c1 < c2) & (c < c1) & (c3.isNull() | (c2 < c3))
    return d.select(
        *bars.columns,
        nz(div0(us, rng)).alias("upper_shadow_ratio"),
        flag(solid & (ls >= body * 2) & (us <= body * 0.3)).alias("candle_hammer"),
        flag(solid & (us >= body * 2) & (ls <= body * 0.3)).alias("candle_shooting_star"),
        flag(solid & (div0(body, rng) < 0.05)).alias("candle_doji"),
        flag(solid & (c1 < o1) & (c > o) & (c >= o1) & (o <= c1)).alias("candle_engulfing_bull"),
        flag(solid & (c1 > o1) & (c < o) & (o >= c1) & (c <= o1)).alias("candle_engulfing_bear"),
        flag(
            solid & (b1 > 0) & (c2 > o2) & (b2 > F.col("_avg") * 0.02) & (b1 < b2 * 0.3) & (c < o) & (c < c2 - b2 * 0.5)
        ).alias("candle_evening_star"),
        flag(solid & rising).alias("candle_three_soldiers"),
        flag(solid & falling).alias("candle_three_crows"),
        flag((body > 0) & (c3.isNotNull()) & (c2 > o2) & (o > c2) & (c < o2 + b2 * 0.5)).alias("candle_dark_cloud"),
        flag((div0(ls, rng) >= 0.3) & (body / (ls + 1e-10) <= 0.5)).alias("candle_long_lower_shadow"),
        flag((body / (c + 1e-10) * 100 < 0.1) & (div0(ls, rng) >= 0.4)).alias("candle_dragonfly"),
    )


def run_lengths(bars: DataFrame) -> DataFrame:
    """``up_run`` and ``down_run``: how many bars in a row, up to this one, closed above (below) the bar before, however many."""
    w = upto()
    d = bars.select("*", F.row_number().over(series()).alias("_i"), lag("close").alias("_p"))
    length = lambda holds: (F.col("_i") - nz(F.max(F.when(~nz(holds, F.lit(False)), F.col("_i"))).over(w), 0)).cast("long")
    return d.select(*bars.columns, length(F.col("close") > F.col("_p")).alias("up_run"), length(F.col("close") < F.col("_p")).alias("down_run"))


def streaks(bars: DataFrame, depth: int = 10) -> DataFrame:
    """Signed run of rises/falls (capped by the lookback), new highs, same-sign days."""
    closes = [F.col("close") if k == 0 else F.col(f"_c{k}") for k in range(depth + 2)]
    d = bars.select("*", *[lag("close", k).alias(f"_c{k}") for k in range(1, depth + 2)], (F.row_number().over(series()) - 1).alias("_i"))
    moves = F.array(*[F.signum(closes[k] - closes[k + 1]) for k in range(depth)])
    d = d.withColumn("_mv", F.filter(moves, lambda v: v.isNotNull()))
    # walk back from the newest move; a turn restarts the count, a flat day ends it
    run = F.aggregate(
        F.col("_mv"),
        F.struct(F.lit(0.0).alias("n"), F.lit(True).alias("on")),
        lambda a, v: F.struct(
            F.when(a["on"] & (v != 0), F.when(a["n"] * v >= 0, a["n"] + v).otherwise(v)).otherwise(a["n"]).alias("n"),
            (a["on"] & (v != 0)).alias("on"),
        ),
        lambda a: a["n"],
    )
    ref = (F.col("close") / closes[5] - 1) * 100
    same = [
        ((closes[k] / closes[k + 1] - 1) * 100 >= 0) == (ref >= 0) for k in range(depth)
    ]
    consistent = F.aggregate(
        F.array(*same),
        F.struct(F.lit(0.0).alias("n"), F.lit(True).alias("on")),
        lambda a, v: F.struct(
            F.when(a["on"] & v, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & v).alias("on")
        ),
        lambda a: a["n"],
    )
    highs = []
    for k in range(1, depth + 1):
        newest = F.greatest(*closes[: k + 1])
        highs.append(F.when(closes[k].isNotNull(), one_if(closes[k - 1] == newest)).otherwise(0))
    return d.select(
        *bars.columns,
        run.alias("streak"),
        sum(highs[1:], highs[0]).cast("double").alias("higher_high_count"),
        F.when((F.col("_i") >= 20) & (F.abs(ref) >= 0.01), consistent).otherwise(0.0).alias("momentum_consistency"),
    )


def liquidity(d: DataFrame) -> DataFrame:
    """Amihud, price impact, Corwin-Schultz spread and log range (needs ``ret``)."""
    per_amt = F.when(F.col("amount") > 0, div0(F.abs(F.col("ret")) / 100, "amount")).otherwise(0.0)
    d = d.select(
        "*", per_amt.alias("_pa"), clip(F.log(F.col("high") / F.col("low")), 0).alias("_hl"),
        lag("high").alias("_h1"), lag("low").alias("_l1"),
        (F.abs(F.col("pct_chg")) / 100 / F.nullif(F.col("amount"), F.lit(0.0)) * 1e6).alias("_am"),
    )
    beta = F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)) + F.pow(F.log(F.col("_h1") / F.col("_l1")), F.lit(2.0))
    gamma = F.pow(F.log(F.greatest("high", "_h1") / F.least("low", "_l1")), F.lit(2.0))
    spread = (F.exp(beta) - F.exp(gamma)) * 2 / F.greatest(F.lit(1e-10), F.exp(beta) + 2 - F.exp(gamma) * 2)
    return d.select(
        *[k for k in d.columns if not k.startswith("_")],
        (mean_n("_pa", 20) * 1e6).alias("amihud_illiq_20d"),
        mean_n("_pa", 20).alias("price_impact"),
        F.when(F.col("_h1").isNotNull(), F.greatest(F.lit(0.0), spread) * 100).otherwise(0.0).alias("corwin_schultz_spread"),
        nz(mean_n("_hl", 20)).alias("high_low_ratio_20d"),
        mean_n("_am", 5).alias("amihud_5d_mean"),
    )


def yang_zhang(bars: DataFrame, n: int = 20) -> DataFrame:
    """Overnight + open-close + Rogers-Satchell variance over the last n bars, from bar n+1 on."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    d = bars.select(
        "*",
        F.log(F.col("open") / lag("close")).alias("_on"),
        F.log(F.col("close") / F.col("open")).alias("_oc"),
        (
            F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open"))
            + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open"))
        ).alias("_rs"),
        F.row_number().over(series()).alias("_n"),
    )
    var = (
        F.var_samp("_on").over(last_n(n - 1)) + F.var_samp("_oc").over(last_n(n)) * k + F.avg("_rs").over(last_n(n)) * (1 - k)
    )
    return d.select(*bars.columns, F.when(F.col("_n") > n, F.sqrt(var) * 100).otherwise(0.0).alias("yang_zhang_vol"))


def decayed_return(d: DataFrame, n: int = 20, rate: float = 0.2) -> DataFrame:
    """Decay-weighted mean of the last n returns, newest heaviest (needs ``ret``)."""
    import math

    weights = [math.exp(-rate * k) for k in range(n)]
    total = sum(weights)
    terms = [(F.col("ret") if k == 0 else lag("ret", k)) * (w / total) for k, w in enumerate(weights)]
    value = sum(terms[1:], terms[0])
    return d.withColumn("exp_wgt_return_20d", F.when(F.row_number().over(series()) > n, value).otherwise(0.0))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjusted: bool = False) -> DataFrame:
    """DIF, its signal line and their difference; ``adjusted`` smooths by weighted averages of the values so far."""
    if adjusted:
        d = with_ewm_adjusted(bars, {"_ef": ("close", span_rate(fast)), "_es": ("close", span_rate(slow))})
        d = d.withColumn("macd_dif", F.col("_ef") - F.col("_es")).drop("_ef", "_es")
        d = with_ewm_adjusted(d, {"macd_signal": ("macd_dif", span_rate(signal))})
    else:
        dif = F.col("_ef") - F.col("_es")
        d = with_ewm_stages(bars, [{"_ef": ("close", span_rate(fast)), "_es": ("close", span_rate(slow))}, {"macd_signal": (dif, span_rate(signal))}])
        d = d.select(*bars.columns, dif.alias("macd_dif"), "macd_signal")
    return d.withColumn("macd_hist", F.col("macd_dif") - F.col("macd_signal"))


def macd_events(d: DataFrame) -> DataFrame:
    """Golden/death cross label, zero crossings of 10 bars, change of the histogram."""
    d = d.select("*", lag("macd_dif").alias("_d1"), lag("macd_signal").alias("_s1"), lag("macd_hist").alias("_h1"))
    dif, sig = F.col("macd_dif"), F.col("macd_signal")
    d = d.withColumn("_z", flag((dif >= 0) & (F.col("_d1") < 0)))
    return d.select(
        *[k for k in d.columns if not k.startswith("_")],
        tiers(
            [
                ((dif > sig) & (F.col("_d1") <= F.col("_s1")), "golden_cross"),
                ((dif < sig) & (F.col("_d1") >= F.col("_s1")), "death_cross"),
            ],
            "neutral",
        ).alias("macd_label"),
        flag(dif > sig).alias("macd_cross_long"),
        nz(F.col("macd_hist") - F.col("_h1")).alias("macd_histogram_accel"),
        sum_n("_z", 10).alias("macd_zero_cross"),
    )


def _gain_loss(bars: DataFrame, fill: bool = False) -> DataFrame:
    d = F.col("close") - lag("close")
    if fill:
        d = nz(d)
    return bars.withColumn("_delta", d).select(
        "*", F.when(F.col("_delta").isNotNull(), F.greatest(F.col("_delta"), F.lit(0.0))).alias("_gain"),
        F.when(F.col("_delta").isNotNull(), F.greatest(-F.col("_delta"), F.lit(0.0))).alias("_loss"),
    ).drop("_delta")


def _rsi(gain: Column, loss: Column, zero_loss: float | None) -> Column:
    return F.when(loss > 0, F.lit(100.0) - F.lit(100.0) / (div0(gain, loss) + 1)).otherwise(F.lit(zero_loss).cast("double"))


def rsi_sma(bars: DataFrame, steps=(14,), zero_loss: float | None = None) -> DataFrame:
    """Rolling-mean RSI; ``zero_loss`` is the value of a window without falls."""
    d = _gain_loss(bars)
    cols = []
    for n in steps:
        g, l = mean_n("_gain", n, n), mean_n("_loss", n, n)
        cols.append(F.when(l.isNotNull(), _rsi(g, l, zero_loss)).alias(f"rsi_{n}"))
    return d.select(*bars.columns, *cols)


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    d = with_ewm(_gain_loss(bars), {"_g": ("_gain", wilder_rate(n)), "_l": ("_loss", wilder_rate(n))}, together=True)
    return d.select(*bars.columns, F.when(F.col("_l").isNotNull(), _rsi(F.col("_g"), F.col("_l"), 100.0)).alias("rsi_w"))


def rsi_ewm14(d: DataFrame) -> DataFrame:
    """RSI of percent returns with span 14; a window without losses counts as balanced (needs ``ret``)."""
    kept = d.columns
    d = d.select("*", F.greatest(F.col("ret"), F.lit(0.0)).alias("_g0"), F.greatest(-F.col("ret"), F.lit(0.0)).alias("_l0"), (F.row_number().over(series()) >= 7).alias("_seen"))
    d = with_ewm(d, {"_g": ("_g0", span_rate(14)), "_l": ("_l0", span_rate(14))}, together=True)
    rs = F.when(F.col("_l") > 1e-10, div0("_g", "_l")).otherwise(1.0)
    return d.select(*kept, F.when(F.col("_seen"), F.lit(100.0) - F.lit(100.0) / (rs + 1)).otherwise(50.0).alias("rsi_14"))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    kept = bars.columns
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    d = bars.select("*", true_range().alias("_tr"), up.alias("_up"), down.alias("_dn"))
    d = d.select(
        "*",
        F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0).alias("_p"),
        F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0).alias("_m"),
    )
    a = wilder_rate(n)
    d = with_ewm(d, {"_atr": ("_tr", a), "_ps": ("_p", a), "_ms": ("_m", a)})
    d = d.select(
        *kept,
        div0(F.col("_ps") * 100, "_atr").alias("plus_di"),
        div0(F.col("_ms") * 100, "_atr").alias("minus_di"),
    )
    dx = F.abs(F.col("plus_di") - F.col("minus_di")) * 100 / (F.col("plus_di") + F.col("minus_di") + 1e-10)
    return with_ewm(d.withColumn("dx", dx), {"adx": ("dx", a)})


def trend_r2(x: str = "close", n: int = 20) -> Column:
    """Squared correlation of the last n values with their position."""
    pos = F.row_number().over(series()).cast("double")
    return F.when(F.count(x).over(last_n(n)) >= n, F.pow(corr(x, "_pos", last_n(n)), F.lit(2.0)))


def trend(bars: DataFrame, n: int = 20) -> DataFrame:
    d = bars.withColumn("_pos", F.row_number().over(series()).cast("double"))
    f = last_n(n)
    full = F.count("close").over(f) >= n
    slope = F.regr_slope("close", "_pos").over(f)
    return d.select(
        *bars.columns,
        F.when(full, nz(trend_r2("close", n)) * 10).alias("trend_r2"),
        F.when(full, slope / F.avg("close").over(f) * 100).alias("trend_slope"),
    )


def find_gaps(bars: DataFrame) -> DataFrame:
    """Rows where the bar lies wholly above or below the previous one."""
    d = bars.select("*", lag("high").alias("prev_high"), lag("low").alias("prev_low"))
    up, dn = F.col("low") > F.col("prev_high"), F.col("high") < F.col("prev_low")
    size = F.when(up, F.col("low") - F.col("prev_high")).when(dn, F.col("prev_low") - F.col("high"))
    return (
        d.where(up | dn)
        .withColumn("kind", F.when(up, "up").otherwise("down"))
        .withColumn("gap_size", size)
        .withColumn("gap_pct", size / F.col("prev_high") * 100)
    )


def forward_return(bars: DataFrame, steps=(5, 10, 20)) -> DataFrame:
    return bars.select("*", *[((lead("close", n) / F.col("close") - 1) * 100).alias(f"fwd_ret_{n}") for n in steps])


def forward_drawdown(bars: DataFrame, n: int = 10, limit: float = -0.05) -> DataFrame:
    """Does the lowest of the next n closes fall ``limit`` below the next close? (3 rows at least)"""
    f = next_n(n)
    first = lead("close", 1)
    dd = (F.min("close").over(f) - first) / first
    return bars.select(
        "*", dd.alias("fwd_dd"), one_if((F.count("close").over(f) >= 3) & (dd <= limit)).alias("risk_label")
    )


def local_peaks(bars: DataFrame, radius: int = 2, x: str = "close") -> DataFrame:
    near = F.max(x).over(series().rowsBetween(-radius, radius))
    peak = (F.col(x) == near) & (F.col(x) > lag(x)) & (F.col(x) > lead(x))
    whole = (F.row_number().over(series()) > radius) & lead(x, radius).isNotNull()
    return bars.withColumn("is_peak", whole & peak)


def drawdown(bars: DataFrame, x: str = "close") -> DataFrame:
    peak = F.max(x).over(upto())
    return bars.select("*", peak.alias("peak"), ((F.col(x) / peak - 1) * 100).alias("drawdown_pct"))


def volume_over_earlier(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over the mean of the n bars before it (today excluded)."""
    f = before_n(n)
    prior = F.when(F.count("vol").over(f) >= n, F.avg("vol").over(f))
    return bars.withColumn("turnover_ratio", F.when(prior > 0, div0("vol", prior)).otherwise(1.0))

"""Pullback events, their recovery, and the rebound confidence per instrument."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div0, nz, one_if, tiers
from ..functions.windows import lag, mean_n, series, upto
from . import indicators as ind
from .snapshots import latest_rows

# Event limits in percent, spacing and spans in bars.
DAY_DROP, RUN_DROP, RUN_DAYS, MIN_GAP, NADIR_SPAN, RECOVERY_SPAN, FIRST_BAR = -3.0, -5.0, 3, 15, 30, 250, 20
CONFIDENCE_WEIGHTS = {"rsi": 0.25, "atr": 0.15, "ma": 0.20, "vol": 0.10, "hist": 0.20, "micro": 0.10}


def candidates(bars: DataFrame) -> DataFrame:
    """Bars with a crash day, a falling run or a deep drawdown; ``i`` counts from 0."""
    d = bars.select(
        "code", "dt", "close", (F.row_number().over(series()) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("code")).alias("n"),
        ((F.col("close") / lag("close") - 1) * 100).alias("_c"), ((F.col("close") / lag("close", RUN_DAYS) - 1) * 100).alias("_r"), ((F.col("close") / F.max("close").over(upto()) - 1) * 100).alias("_d"),
    )
    hit = (nz("_c") <= DAY_DROP) | nz(F.col("_r") <= RUN_DROP, False) | (F.col("_d") <= RUN_DROP)
    return d.withColumn("hit", hit & (F.col("i") >= FIRST_BAR) & (F.col("i") < F.col("n") - 1))


def spaced(hits: DataFrame, gap: int = MIN_GAP) -> DataFrame:
    """Greedy thinning: an event blocks the next ``gap`` bars. Sequential by nature, so one
    Arrow group per code (its bars are bounded by the calendar)."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        chosen, last = [], -gap
        for pos in pdf["i"]:
            ok = pos - last >= gap
            chosen.append(ok)
            last = pos if ok else last
        return pdf[chosen]

    return hits.groupBy("code").applyInPandas(keep, hits.schema)


def pullback_events(bars: DataFrame, gap: int = MIN_GAP, nadir_span: int = NADIR_SPAN, recovery_span: int | None = RECOVERY_SPAN) -> DataFrame:
    """Events with the low of the ``nadir_span`` bars from the event on and the bars it took from there to regain the entry price.

    ``recovery_days`` is -1 if that is not seen within ``recovery_span`` bars (None: up to the last bar); ``censored`` tells
    whether the bars end before the span does, so that a recovery may still come."""
    c = candidates(bars).where("n >= 60")
    ev = spaced(c.where("hit").select("code", "dt", "close", "i"), gap).select("code", F.col("dt").alias("event_dt"), F.col("close").alias("entry"), F.col("i").alias("e"))
    px = c.select("code", "i", "close")
    near = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(nadir_span - 1))).alias("_k")).withColumn("i", F.col("e") + F.col("_k")).join(px, ["code", "i"])
    low = near.groupBy("code", "event_dt", "entry", "e").agg(F.min(F.struct("close", "i")).alias("_m"))
    low = low.select("code", "event_dt", "entry", "e", F.col("_m.close").alias("nadir"), F.col("_m.i").alias("nadir_i"))
    low = low.join(c.groupBy("code").agg((F.max("i")).alias("_end")), "code")
    rest = F.col("_end") - F.col("nadir_i")  # bars after the low
    span = rest if recovery_span is None else F.least(rest, F.lit(recovery_span - 1))
    ahead = low.select("code", "event_dt", "entry", "nadir_i", F.explode(F.sequence(F.lit(0).cast("long"), span.cast("long"))).alias("_k")).withColumn("i", F.col("nadir_i") + F.col("_k"))
    back = ahead.join(px, ["code", "i"]).where(F.col("close") >= F.col("entry")).groupBy("code", "event_dt").agg(F.min("_k").alias("_rec"))
    return low.join(back, ["code", "event_dt"], "left").select(
        "code", "event_dt", "entry", "nadir", (F.col("nadir_i") - F.col("e")).cast("int").alias("duration"), ((F.col("nadir") / F.col("entry") - 1) * 100).alias("max_drawdown_pct"), nz("_rec", -1).cast("int").alias("recovery_days"),
        (F.col("_rec").isNull() & (F.lit(True) if recovery_span is None else rest < recovery_span - 1)).alias("censored"),
    )


def recovery_confidence(bars: DataFrame, events: DataFrame, margin: DataFrame | None = None) -> DataFrame:
    """Newest oversold readings per code blended with the recovery record into a confidence and verdict."""
    shadow = ind.candles(bars).select("code", "dt", F.greatest("candle_long_lower_shadow", "candle_dragonfly").alias("_sh"))
    d = ind.atr_wilder(ind.rsi_wilder(bars)).join(shadow, ["code", "dt"])
    d = d.select(
        "code", "dt", "close", nz("rsi_w", 50.0).alias("rsi"), div0("atr_w", mean_n("atr_w", 20, 20)).alias("atr_ratio"), div0("vol", mean_n("vol", 20, 20)).alias("vol_ratio"),
        *[((F.col("close") / mean_n("close", n, n) - 1) * 100).alias(f"dev{n}") for n in (5, 20, 60)], ((F.col("close") / F.max("close").over(upto()) - 1) * 100).alias("drawdown"),
        F.max("_sh").over(series().rowsBetween(-4, 0)).alias("_shadow"),
    )
    d = latest_rows(d)
    hist = events.groupBy("code").agg(F.count(F.lit(1)).alias("n_events"), F.avg(one_if(F.col("recovery_days") >= 0)).alias("_rate"), F.avg(F.when(F.col("recovery_days") >= 0, F.col("recovery_days"))).alias("mean_days"))
    d = d.join(hist, "code", "left")
    if margin is not None:
        d = d.join(margin.select("code", F.col("detected").cast("int").alias("_mg")), "code", "left")
    else:
        d = d.withColumn("_mg", F.lit(0))
    rsi, extreme = F.col("rsi"), one_if(F.col("dev5") <= -3) + one_if(F.col("dev20") <= -5) + one_if(F.col("dev60") <= -8)
    parts = {
        "rsi": tiers([(rsi <= 18, 1.0), (rsi <= 25, 0.7), (rsi >= 75, 0.1), (rsi.between(30, 50), 0.5)], 0.3),
        "atr": F.when(F.col("atr_ratio") >= 2, 1.0).otherwise(0.3),
        "ma": F.least(F.lit(1.0), extreme / 3),
        "vol": tiers([(F.col("vol_ratio") >= 2, 0.8), (F.col("vol_ratio") <= 0.6, 0.6)], 0.3),
        "hist": nz("_rate", 0.5),
        "micro": (nz("_shadow") + nz("_mg", 0)) / 3,
    }
    total = sum((parts[k] * w for k, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    depth = F.abs("drawdown")
    factor = tiers([(depth < 5, 1.0), (depth < 10, 1.3), (depth < 20, 1.6)], 2.0) * tiers([(rsi <= 25, 0.9), (rsi <= 35, 1.0)], 1.1)
    d = d.withColumn("confidence", F.round(total, 2))
    verdict = tiers([(F.col("confidence") >= 0.75, "likely_rebound"), (F.col("confidence") >= 0.5, "watch_rebound"), (F.col("confidence") >= 0.3, "cautious")], "healthy_trend")
    window = F.when(F.col("mean_days").isNotNull(), F.greatest(F.lit(3), F.floor(F.col("mean_days") * factor))).otherwise(15)
    return d.select("code", "dt", "rsi", "atr_ratio", "vol_ratio", "drawdown", nz("n_events", 0).alias("n_events"), "mean_days", "confidence", verdict.alias("verdict"), window.cast("int").alias("adjusted_days"))


def margin_extreme(margin: DataFrame, percentile: float = 10.0, drop: float = -0.5, days: int = 3) -> DataFrame:
    """Newest 3-day balance change in its own low tail, or a run of falling days, per code."""
    # rounded: the newest value is compared with its own history
    chg = lambda k: F.round(div0(F.col("rzye") - lag("rzye", k), F.abs(lag("rzye", k))) * 100, 9)
    d = margin.select("code", "dt", chg(1).alias("c1"), chg(3).alias("c3"))
    run = F.sum(one_if(F.col("c1") < drop)).over(series().rowsBetween(-(days - 1), 0)) >= days
    d = d.withColumn("_run", run)
    newest = latest_rows(d).select("code", "dt", F.col("c3").alias("_now"), "_run")
    share = d.join(newest.select("code", "_now"), "code").where("c3 is not null").groupBy("code").agg((F.avg(one_if(F.col("c3") <= F.col("_now"))) * 100).alias("pct"))
    d = newest.join(share, "code", "left")
    return d.select("code", "dt", F.col("_now").alias("chg_3d"), nz("pct", 50.0).alias("percentile"), (nz(F.col("pct") <= percentile, False) | F.col("_run")).alias("detected"))


def peak_divergence(d: DataFrame, radius: int = 5, n: int = 60) -> DataFrame:
    """The last two confirmed price peaks of the window rise while DIF does not (needs ``macd_dif``)."""
    w = series()
    peak = (F.col("close") > F.max("close").over(w.rowsBetween(-radius, -1))) & (F.col("close") > F.max("close").over(w.rowsBetween(1, radius)))
    d = d.select("*", (F.row_number().over(w)).alias("_i"), F.count("close").over(w.rowsBetween(1, radius)).alias("_a"), peak.alias("_pk"))
    d = d.withColumn("_p", F.when(F.col("_pk") & (F.col("_i") > radius) & (F.col("_a") == radius), F.struct(F.col("_i").alias("i"), F.col("close").alias("c"), F.col("macd_dif").alias("d"))))
    d = d.withColumn("_q", F.when(F.col("_p").isNotNull(), F.struct(F.col("_p").alias("cur"), F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"))))
    # a peak is known ``radius`` bars later and must have ``radius`` window bars before it
    d = d.withColumn("_l", F.last("_q", ignorenulls=True).over(w.rowsBetween(-(n - 1 - radius), -radius)))
    cur, prev = F.col("_l.cur"), F.col("_l.prev")
    ok = (F.col("_i") >= n) & (prev["i"] >= F.col("_i") - (n - 1 - radius)) & (cur["c"] > prev["c"]) & (cur["d"] <= prev["d"])
    return d.withColumn("peak_divergence", nz(ok, False)).drop("_i", "_a", "_pk", "_p", "_q", "_l")

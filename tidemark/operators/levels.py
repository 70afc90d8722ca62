"""Volume profile and key price levels per instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div0, nz, rd
from ..functions.windows import lag, max_n, mean_n, min_n, series, std_n, upto
from .snapshots import latest_rows


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The n newest bars per code with ``_k`` counting back from 1."""
    k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))
    return bars.withColumn("_k", k).where(F.col("_k") <= n)


def volume_profile(bars: DataFrame, n: int = 60, bins: int = 20) -> DataFrame:
    """Price bin with the largest volume among the last n bars: bin bounds, centre, share.

    Bins are right-closed; a typical price on the lowest edge belongs to none.
    """
    d = last_bars(bars, n).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    ends = d.groupBy("code").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    d = d.join(ends, "code")
    width = (F.col("_hi") - F.col("_lo")) / bins
    d = d.withColumn("_w", width).withColumn("bin", F.when(F.col("_w") > 0, F.ceil(div0(F.col("_tp") - F.col("_lo"), "_w")) - 1).otherwise(0))
    per = d.where(F.col("bin").between(0, bins - 1)).groupBy("code", "bin").agg(F.sum("vol").alias("_v"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    # bins per code are few
    w = Window.partitionBy("code")
    best = per.select("*", F.sum("_v").over(w).alias("_t"), F.row_number().over(w.orderBy(F.desc("_v"), "bin")).alias("_r")).where("_r = 1")
    lower, upper = F.col("_lo") + F.col("_w") * F.col("bin"), F.col("_lo") + F.col("_w") * (F.col("bin") + 1)
    return best.select(
        "code", upper.alias("zone_upper"), lower.alias("zone_lower"), ((lower + upper) / 2).alias("zone_center"), (F.col("_v") / F.col("_t") * 100).alias("zone_volume_pct")
    )


def key_levels(bars: DataFrame) -> DataFrame:
    """Supports, resistances and the nearest breakout level of the newest bar per code."""
    up_gap = F.col("low") > lag("high")
    d = bars.select(
        "*", mean_n("close", 20, 20).alias("ma20"), mean_n("close", 60, 60).alias("ma60"), mean_n("close", 120, 120).alias("ma120"),
        std_n("close", 20, 20).alias("_s"), min_n("low", 30).alias("low30"), min_n("low", 60).alias("low60"), max_n("high", 30).alias("high30"),
        max_n("high", 60).alias("high60"), max_n("high", 120).alias("high120"), div0("vol", mean_n("vol", 20, 20)).alias("volume_ratio"),
        F.min("close").over(upto()).alias("_minc"), F.when(up_gap, F.col("high")).alias("_gt"), F.row_number().over(series()).alias("_n"),
    )
    # a gap inside the last 30 bars compares 29 pairs
    d = d.withColumn("gap_top", F.last("_gt", ignorenulls=True).over(series().rowsBetween(-28, 0)))
    d = latest_rows(d).join(volume_profile(bars), "code", "left")
    px, upper = F.col("close"), F.col("ma20") + F.col("_s") * 2
    cands = F.filter(F.array(upper, F.col("high30"), F.col("gap_top")), lambda v: v.isNotNull() & (v > 0))
    d = d.withColumn("_up", upper).withColumn("_c", cands)
    above = F.array_min(F.filter("_c", lambda v: v > F.col("close")))
    m120 = F.coalesce("ma120", "_minc")
    return d.select(
        "code", "dt", px.alias("close_price"), "volume_ratio",
        F.least("ma20", "ma60", "low30").alias("strong_support"),
        F.least(m120, F.col("low60")).alias("ultra_support"),
        F.when(F.col("ma60").isNotNull() & F.col("ma120").isNotNull(), F.greatest("ma60", "ma120")).otherwise(F.greatest("high60", "high120")).alias("resistance_mid"),
        F.greatest("high60", "high120", nz("zone_upper")).alias("resistance_high"),
        F.coalesce(above, F.col("_up"), F.col("high30")).alias("breakout_confirm"),
        ((F.col("high") + F.col("low") + px) / 3).alias("vwap"),
        "_up", "ma20", (F.col("ma20") * 2 - F.col("_up")).alias("_lo"),
    ).withColumnsRenamed({"_up": "boll_upper", "_lo": "boll_lower", "ma20": "boll_mid"})

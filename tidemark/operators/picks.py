"""Scoring and selection of instruments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, div0, nz, one_if, rd, tiers
from ..functions.windows import lag, lead, mean_n, momentum, std_n
from ..session import materialised
from .cross import minmax, top_n
from .indicators import true_range
from .predicates import MIN_PRICE, dso
from .snapshots import latest_rows

# Fixed weights of the daily score, the sector score and the industry selection.
DAY_WEIGHTS = {
    "momentum_5d": 0.25, "momentum_20d": 0.20, "volatility_20d": 0.15, "volume_ratio": 0.15, "ma20_deviation": 0.10, "rel_strength": 0.15,
}
SECTOR_WEIGHTS = {"excess": 0.25, "momentum": 0.20, "volume": 0.20, "trend": 0.20, "liquidity": 0.15}
STOCK_WEIGHTS = {"excess_return": 0.5, "momentum_5d": 0.3, "ma20_deviation": 0.2}


def day_factors(bars: DataFrame, horizon: int = 5) -> DataFrame:
    d = bars.select(
        "code", "dt", "close", "vol", *[momentum(n).alias(f"momentum_{n}d") for n in (5, 10, 20)],
        (F.col("close") / lag("close") - 1).alias("_r"), mean_n("vol", 5, 3).alias("_v5"), mean_n("vol", 20, 10).alias("_v20"), mean_n("close", 20, 15).alias("_ma"),
        true_range().alias("_tr"), ((lead("close", horizon) / F.col("close") - 1) * 100).alias("forward_return"),
    )
    year = F.sqrt(F.lit(252.0)) * 100
    return d.select(
        "code", "dt", "close", "vol", "momentum_5d", "momentum_10d", "momentum_20d", "forward_return",
        (std_n("_r", 5, 5) * year).alias("volatility_5d"), (std_n("_r", 20, 5) * year).alias("volatility_20d"),
        div0("_v5", "_v20").alias("volume_ratio"), ((F.col("close") / F.col("_ma") - 1) * 100).alias("ma20_deviation"),
        (div0(mean_n("_tr", 14, 7), "close") * 100).alias("atr_ratio"),
    )


def day_scores(factors: DataFrame, weights: Mapping[str, float] = DAY_WEIGHTS) -> DataFrame:
    """Weighted raw factors of tradable rows; a missing factor adds nothing."""
    ok = factors.where((F.col("close") >= MIN_PRICE) & (F.col("vol") > 0) & F.col("momentum_5d").isNotNull())
    # A row a date: stored, it is known to be small, and the factors need not be shuffled by date to meet it.
    means = materialised(ok.groupBy("dt").agg(F.avg("momentum_20d").alias("_m")))
    d = ok.join(means, "dt", "left").withColumn("rel_strength", F.col("momentum_20d") - F.col("_m")).drop("_m")
    return d.withColumn("score", sum((nz(k) * w for k, w in weights.items()), F.lit(0.0)))


def day_picks(factors: DataFrame, n: int = 10) -> DataFrame:
    return top_n(day_scores(factors), ["dt"], "score", n)


def industry_picks(bars: DataFrame, industry_bars: DataFrame, members: DataFrame, industry_scores: DataFrame, top_industries: int = 6, min_members: int = 8, top: int = 5, weights: Mapping[str, float] = STOCK_WEIGHTS) -> DataFrame:
    """Best instruments of the best industries: factors scaled inside the industry, weighted, ranked.

    members: (code, industry); industry_bars keyed by industry code; industry_scores: (code, persistence_score).
    """
    best = industry_scores.orderBy(F.desc("persistence_score"), "code").limit(top_industries).select(F.col("code").alias("industry"))
    own = latest_rows(
        bars.select("code", "dt", "close", momentum(20).alias("momentum_20d"), nz(momentum(5)).alias("momentum_5d"), nz((F.col("close") / mean_n("close", 20, 20) - 1) * 100).alias("ma20_deviation")),
        min_rows=21,
    )
    par = latest_rows(industry_bars.withColumn("_ir", momentum(20)), min_rows=21).select(F.col("code").alias("industry"), "_ir")
    d = own.join(members.select("code", "industry"), "code").join(best, "industry", "left_semi").join(par, "industry")
    d = d.withColumn("excess_return", F.col("momentum_20d") - F.col("_ir")).drop("_ir")
    sizes = d.groupBy("industry").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_members)
    d = minmax(d.join(sizes, "industry", "left_semi"), ["industry"], {f"{k}_score": k for k in weights})
    d = d.withColumn("score", rd(sum((F.col(f"{k}_score") * w for k, w in weights.items()), F.lit(0.0)), 2))
    return top_n(d, ["industry"], "score", top)


def sector_picks(bars: DataFrame, industry_bars: DataFrame, members: DataFrame, sectors: DataFrame, per_sector: int = 5, total: int = 25) -> DataFrame:
    """Five clipped linear scores per member of the chosen sectors, best five each, best ``total`` overall."""
    f = bars.select(
        "code", "dt", "close", momentum(25).alias("_m25"), momentum(20).alias("_m20"), mean_n("vol", 5).alias("_v5"), mean_n("vol", 20).alias("_v20"),
        ((F.col("close") / mean_n("close", 20) - 1) * 100).alias("price_dev"), mean_n("amount", 20).alias("avg_amount"), F.first("close").over(Window.partitionBy("code").orderBy("dt").rowsBetween(-25, 0)).alias("_c0"),
    )
    own = latest_rows(f, min_rows=21).withColumn("ret", (F.col("close") / F.col("_c0") - 1) * 100)
    bench = latest_rows(industry_bars.withColumn("_b", momentum(20)), min_rows=21).select(F.col("code").alias("industry"), F.col("_b").alias("bench_ret"))
    d = own.join(members.select("code", "industry"), "code").join(sectors.select("industry"), "industry", "left_semi").join(bench, "industry")
    parts = {
        "excess": clip((F.col("ret") - F.col("bench_ret") + 10) / 2, 0, 10), "momentum": clip((F.col("ret") + 5) / 2, 0, 10),
        "volume": clip((nz(div0("_v5", "_v20"), 1.0) - 0.5) * 5, 0, 10), "trend": clip((F.col("price_dev") + 5) / 2, 0, 10),
        "liquidity": clip(F.log10(F.col("avg_amount") + 1) / 8 * 10, 0, 10),
    }
    d = d.select("code", "industry", "ret", "bench_ret", "price_dev", *[e.alias(f"s_{k}") for k, e in parts.items()])
    d = d.withColumn("score", rd(sum((F.col(f"s_{k}") * w for k, w in SECTOR_WEIGHTS.items()), F.lit(0.0)), 1))
    return top_n(d, ["industry"], "score", per_sector).drop("rk").orderBy(F.desc("score"), "code").limit(total)


# Fixed thresholds of the fundamental bonus.
CFO_HEALTHY, CFO_WEAK, FCF_HIGH, FCF_FAIR = 1.0, 0.8, 0.05, 0.02


def fundamental_scores(valuation: DataFrame, statements: DataFrame, members: DataFrame, mv_scale: float = 1.0) -> DataFrame:
    """Bonus per code from the newest valuation and annual statement: cheapness inside the
    industry (share strictly below), ROE and its trend, cash quality, FCF yield, DSO; bounded to -2..5."""
    from ..functions.ranks import with_rank_columns

    hist = valuation.select("code", "dt", "pe_ttm", "pb", "roe", "ar_turn", "total_mv", lag("roe").alias("_roe1"))
    v = latest_rows(hist).join(members.select("code", "industry"), "code")
    below = {k: F.when(F.col("n_group") > 1, F.col("n_below") / F.col("n_group")) for k in ("pe", "pb")}
    v = with_rank_columns(v, ["industry"], "pe_ttm", pe_pct=below["pe"])
    v = with_rank_columns(v, ["industry"], "pb", pb_pct=below["pb"])
    s = statements.where("report_type = '1'").groupBy("code").agg(F.max_by(F.struct("n_income", "cfo", "fcf"), "end_date").alias("_s")).select("code", "_s.*")
    d = v.join(s, "code", "left")
    ratio, fy, days = rd(div0("cfo", "n_income"), 2), rd(div0("fcf", F.col("total_mv") * mv_scale)), dso("ar_turn")
    d = d.select("*", ratio.alias("cfo_np"), F.when(F.col("total_mv") > 0, fy).alias("fcf_yield"), days.alias("dso"), div0(F.col("roe") - F.col("_roe1"), F.abs("_roe1")).alias("roe_trend"))
    parts = {
        "pe_bonus": F.when(F.col("pe_ttm") > 0, rd(F.lit(1.0) - F.col("pe_pct"), 2)),
        "pb_bonus": F.when(F.col("pb") > 0, rd((F.lit(1.0) - F.col("pb_pct")) * 0.5, 2)),
        "roe_bonus": F.when(F.col("roe") > 0, rd(F.least(F.lit(1.0), F.col("roe") / 15), 2) + F.when(F.col("roe_trend") > 0.05, 0.3).otherwise(0.0)),
        "cash_bonus": tiers(
            [((F.col("n_income") > 0) & (F.col("cfo_np") >= CFO_HEALTHY), 0.5), ((F.col("n_income") > 0) & (F.col("cfo_np") < CFO_WEAK), -0.3), ((F.col("n_income") < 0) & (F.col("cfo") <= 0), -0.2)], 0.0
        ),
        "fcf_bonus": tiers([(F.col("fcf_yield") >= FCF_HIGH, 1.0), (F.col("fcf_yield") >= FCF_FAIR, 0.5), (F.col("fcf_yield") < 0, -0.3)], 0.0),
        "dso_bonus": tiers([(F.col("dso") <= 60, 0.3), (F.col("dso") <= 90, 0.0), (F.col("dso") <= 120, -0.2), (F.col("dso") > 120, -0.4)], 0.0),
    }
    d = d.select("code", "industry", "pe_pct", "pb_pct", "roe", "roe_trend", "cfo_np", "fcf_yield", "dso", *[nz(e).alias(k) for k, e in parts.items()])
    return d.withColumn("funda_bonus", clip(sum((F.col(k) for k in parts), F.lit(0.0)), -2, 5))


def consensus(fragility: DataFrame, regimes: DataFrame, zone_counts: DataFrame) -> DataFrame:
    """Sum of risk level, regime and zone breadth per date, bounded to -7..7."""
    d = fragility.select("dt", "alert_level").join(regimes.select("dt", "regime_v2", "adx"), "dt", "left").join(zone_counts, "dt", "left")
    risk = tiers([(F.col("alert_level") == "danger", -3), (F.col("alert_level") == "warning", -2), (F.col("alert_level") == "caution", -1)], 0)
    v2 = F.col("regime_v2")
    reg = tiers([(v2 == "bear", -2), (v2.isin("range_down", "pullback"), -1), (v2 == "rebound", 1), (v2.isin("early_bull", "bull"), 2)], 0)
    total = F.col("chase") + F.col("watch") + F.col("top_warn") + F.col("weak")
    breadth = F.floor(F.bround(nz(div0((F.col("chase") - F.col("weak")) * 4.0, total)), 0) / 2)
    score = F.greatest(F.least(risk + reg + breadth, F.lit(7)), F.lit(-7)).cast("int")
    strength = tiers([(F.col("adx") > 30, "strong"), (F.col("adx") > 20, "medium"), (F.col("adx").isNotNull(), "weak")], None)
    return d.select("dt", "alert_level", "regime_v2", score.alias("score"), strength.alias("trend_strength"), one_if(total > 0).alias("has_zones"))

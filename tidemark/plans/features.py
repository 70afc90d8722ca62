"""The feature matrix: stages of columns over (code, dt), each double-valued."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import asof_merge
from ..functions.ranks import with_pct_ranks
from ..functions.scalar import clip, div0, flag, nz, safe_div
from ..functions.windows import lag, mean_n, series, std_n
from ..operators import cross, dependence as dep, flows, fundamentals, indicators as ind, industry as iops, market as mkt
from ..operators.panel_scores import persistence_panel
from ..operators.predicates import board_type, wide_limit
from ..session import materialised

WARM_UP = 20


def mask(features: DataFrame, pool: Sequence[str], keys: Sequence[str] = ("code", "dt", "close")) -> DataFrame:
    """Keys and the pool columns that exist."""
    have = set(features.columns)
    return features.select(*keys, *[c for c in dict.fromkeys(pool) if c in have and c not in keys])


@dataclass
class Inputs:
    """Panels the matrix is built from; ``members`` has code, l1, l2, and l3 if ``l3`` is given."""

    bars: DataFrame
    members: DataFrame
    l1: DataFrame
    l2: DataFrame
    margin: DataFrame | None = None
    flow: DataFrame | None = None
    valuation: DataFrame | None = None
    statements: DataFrame | None = None
    l3: DataFrame | None = None


# ---- stage 1: windows over one instrument ---------------------------------------------------


def trend_stage(panel: DataFrame) -> DataFrame:
    d = ind.daily_return(ind.momenta(panel))
    d = ind.ma_order(ind.moving_averages(d))
    d = ind.volume_family(d)
    d = ind.bar_shape(ind.atr_sma(d))
    return ind.streaks(ind.candles(d))


def pattern_stage(d: DataFrame) -> DataFrame:
    d = ind.return_stats(d)
    d = ind.vwap(ind.bollinger(d))
    d = ind.liquidity(d)
    d = d.select("*", ind.max_drawdown_n().alias("max_drawdown_20d"), ind.price_position(20).alias("price_position_20d"), ind.price_position(60).alias("price_position_60d"))
    return ind.rsi_ewm14(ind.yang_zhang(ind.decayed_return(d)))


def products(d: DataFrame) -> DataFrame:
    """Ratios and products of the price stage."""
    return d.select(
        "*",
        nz(div0("mom5", "mom20")).alias("mom_ratio_5_20"), (nz("mom5") - nz("mom20")).alias("mom_accel"), nz(div0("mom20", "atr_pct")).alias("vol_adjusted_mom20"),
        nz(div0("vol_ratio", "atr_pct")).alias("vol_amplitude_ratio"), nz(F.col("vol_ratio") * (F.col("close") / F.col("ma20") - 1) * 100).alias("vol_conviction"),
        nz(F.col("mom5") * F.col("vol_ratio")).alias("momentum_volume"), flag((F.col("streak") >= 2) & (F.col("vol_ratio") < 0.8)).alias("price_volume_diverg"),
        nz(F.col("bb_pct_b") * F.col("streak")).alias("bb_streak"), nz(F.col("gap_pct") * F.col("mom5")).alias("gap_momentum"),
        nz(F.col("price_position_20d") * F.col("vol_ratio") / 100).alias("position_conviction"), nz(F.col("vol_ratio") * F.col("max_drawdown_20d")).alias("vol_drawdown"),
    )


EXTRA_MOM = (2, 3, 4, 7, 12, 15, 30, 45, 75, 90, 120)


def momentum_mix(d: DataFrame) -> DataFrame:
    """Harmonic mean of the absolute momenta and ratio of their positive to negative sums."""
    cols = [F.col(f"mom{n}") for n in EXTRA_MOM]
    inverse = sum((F.lit(1.0) / F.greatest(F.abs(nz(c)), F.lit(0.01)) for c in cols), F.lit(0.0))
    up = sum((F.greatest(nz(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    down = sum((F.greatest(-nz(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return d.select("*", (F.lit(float(len(cols))) / inverse).alias("mom_harmonic_mean"), div0(up, down).alias("mom_frequency_ratio"))


FULL_MAS = (3, 8, 15, 30, 40, 80, 90)


def extended_stage(d: DataFrame) -> DataFrame:
    """Second set of averages, MACD, RSI lengths, band events, realised volatility."""
    d = d.select("*", *[((F.col("close") / mean_n("close", n, n) - 1) * 100).alias(f"ma{n}_dev") for n in FULL_MAS],
                 *[mean_n("close", n, n).alias(f"_f{n}") for n in (5, 10, 20, 60, 120)])
    m = {n: F.col(f"_f{n}") for n in (5, 10, 20, 60, 120)}
    d = d.select(
        "*", flag((m[5] > m[10]) & (m[10] > m[20])).alias("ma_short_arrangement"), flag((m[20] > m[60]) & (m[60] > m[120])).alias("ma_long_arrangement"),
        ((m[5] - m[10]) / F.col("close") * 100).alias("ma5_ma10_gap"), ((m[20] - m[60]) / F.col("close") * 100).alias("ma20_ma60_gap"),
    ).drop(*[f"_f{n}" for n in m])
    d = momentum_mix(d)
    d = ind.macd_events(ind.macd(d))
    d = ind.rsi_sma(d, (3, 5, 7, 21, 60)).withColumn("rsi_momentum", F.col("rsi_5") - F.col("rsi_21"))
    d = ind.bollinger_events(d)
    d = ind.realised_vol(d)
    return d.withColumn("volume_shock_indicator", div0("vol", "vma20"))


def window_stage(panel: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All per-instrument windows, as three stored blocks over narrow rows joined on (code, dt), and the first block.

    A window copies every column of its input row, so the blocks start from the bars (plus
    the few columns they read) instead of one ever wider chain. The first one also has l1 and l2: it lies by code
    when its windows are done, so that ``members`` needs no move of rows.
    """
    keys, raw = ["code", "dt"], panel.columns
    trend = materialised(trend_stage(panel).join(members.select("code", "l1", "l2"), "code", "left"))
    pattern = pattern_stage(ind.daily_return(panel))
    pattern = materialised(pattern.select(*keys, *[c for c in pattern.columns if c not in {*raw, "ret"}]))
    reads = [*raw, *[f"mom{n}" for n in ind.MOMENTUM_STEPS], "vma20"]
    ext = extended_stage(trend.select(*reads)).withColumn("_bar", F.row_number().over(series()))
    ext = materialised(ext.select(*keys, *[c for c in ext.columns if c not in reads]))
    return products(trend.join(pattern, keys).join(ext, keys)), trend


def calendar_columns(day: Column) -> dict[str, Column]:
    """Weekday code, start/end of month, ISO week, earnings months, year end, tax-loss window."""
    wd = F.weekday(day)
    return {
        "day_of_week_effect": F.when(wd == 0, 1.0).when(wd == 4, 5.0).when(wd == 1, 2.0).when(wd == 2, 3.0).when(wd == 3, 4.0).otherwise(3.0),
        "monthly_mean_reversion_signal": flag(F.dayofmonth(day) <= 5),
        "annual_pattern_week_nr": F.weekofyear(day).cast("double"),
        "quarter_earnings_window": flag(F.month(day).isin(1, 4, 7, 10)),
        "month_end_effect": flag(day == F.last_day(day)),
        "year_end_window_dressing": flag(F.month(day) == 12),
        "tax_loss_selling_window": flag((F.month(day) == 12) & (F.dayofmonth(day) >= 15)),
    }


# ---- stage 2: industry and market joins -------------------------------------------------------


def group_stage(d: DataFrame, panel: DataFrame, x: Inputs) -> DataFrame:
    """Hierarchy excess of the rows of ``d`` (code, dt, mom20), and beta, as a narrow table."""
    index = mkt.market_index(x.l1)
    market = panel.groupBy("dt").agg((F.avg("pct_chg") / 100).alias("mkt_ret"))
    narrow = d.select("code", "dt", "mom20")
    h = iops.hierarchy_features(narrow, x.members, x.l1, x.l2, index).drop("mom20")
    b = dep.beta(panel.select("code", "dt", "pct_chg"), market).drop("pct_chg")
    if x.l3 is not None:  # a third level below the two
        tree = iops.closure(_edges(x.members), x.members.select("code", F.concat(F.lit("l3:"), "l3").alias("parent")))
        named = [bars.select(F.concat(F.lit(f"{level}:"), "code").alias("code"), "dt", "close") for level, bars in (("l1", x.l1), ("l2", x.l2), ("l3", x.l3))]
        deep = iops.hierarchy_levels(narrow, tree, reduce(DataFrame.unionByName, named), index).where("level = 3")
        h = h.join(deep.select("code", "dt", F.col("excess_return").alias("excess_return_l3"), F.col("divergence").alias("L3_L2_divergence")), ["code", "dt"], "left")
    return h.join(b, ["code", "dt"], "left")


def day_stage(d: DataFrame, panel: DataFrame, x: Inputs) -> DataFrame:
    """Industry ecology and ranks, persistence, market breadth on rows with l1 and l2.

    Each side has a row a date and industry, or a date. The sides are stored, so the planner knows that they are
    small; by the guess it makes of an aggregate, every join would move the whole matrix.
    """
    board = wide_limit("code")
    for level in ("l1", "l2"):
        lim = iops.limit_moves(panel, x.members, level, board).select(
            "dt", level, *[F.col(c).alias(f"{c}_{level}") for c in ("lt_count", "lt_rate", "dt_count", "lt_to_dt_ratio", "up_pct")]
        )
        day = iops.industry_day(panel, x.members, level).select("dt", level, F.col("ind_rank").alias(f"rank_{level}_in_all"), F.col("ind_chg").alias(f"_chg_{level}"))
        d = d.join(materialised(lim.join(day, ["dt", level])), ["dt", level], "left")
    d = d.withColumn("stock_vs_L1_alpha_daily", nz(F.col("pct_chg") - F.col("_chg_l1"))).drop("_chg_l1", "_chg_l2", "up_pct_l2")
    d = d.withColumns({f"rank_{v}_in_all": nz(f"rank_{v}_in_all", 50.0) for v in ("l1", "l2")})
    persistence = persistence_panel(x.l1).select(F.col("code").alias("l1"), "dt", F.col("score").alias("sector_persistence"))
    return d.join(materialised(persistence), ["l1", "dt"], "left").join(materialised(mkt.breadth_features(panel)), "dt", "left")


def _edges(members: DataFrame) -> DataFrame:
    """child and parent of the industry levels of ``members``, named by level."""
    name = lambda level: F.concat(F.lit(f"{level}:"), level)
    pairs = [members.select(name(low).alias("child"), name(high).alias("parent")) for low, high in (("l3", "l2"), ("l2", "l1"))]
    return pairs[0].unionByName(pairs[1]).distinct()


RANKS = {
    "rank_mom20": "mom20", "rank_vol_ratio": "vol_ratio", "rank_atr_pct": "atr_pct", "rank_excess_return_l1": "excess_return_l1", "rank_amount": "amount",
    "rank_price_position_20d": "price_position_20d", "rank_turnover_ratio": "turnover_ratio_5d_20d", "rank_exp_wgt_return": "exp_wgt_return_20d",
}
ZSCORES = {"zscore_mom20": "mom20", "zscore_excess_return": "excess_return_l1", "zscore_vol_ratio": "vol_ratio"}


# ---- stage 3: external panels and composites -----------------------------------------------


def valuation_features(valuation: DataFrame, members: DataFrame) -> DataFrame:
    """Earnings yield and percentiles inside the industry of the date (50 for tiny or equal groups)."""
    d = valuation.join(members.select("code", "l1"), "code", "left").withColumn("earnings_yield", F.when(F.col("pe_ttm") > 0, safe_div(F.lit(1.0), "pe_ttm")).otherwise(0.0))
    from ..functions.ranks import average_rank, with_rank_columns

    for k in ("pe_ttm", "pb"):
        name = {"pe_ttm": "pe_industry_percentile", "pb": "pb_industry_percentile"}[k]
        value = F.when((F.col("n_group") > 2) & (F.col("n_tie") < F.col("n_group")), average_rank() / F.col("n_group") * 100).otherwise(50.0)
        d = with_rank_columns(d, ["dt", "l1"], k, **{name: value}).withColumn(name, nz(name, 50.0))
    return d.drop("l1")


def statement_ratios(statements: DataFrame) -> DataFrame:
    """Ratios of the newest annual statement per code."""
    s = statements.where("report_type = '1'").groupBy("code").agg(
        F.max_by(F.struct("n_income", "cfo", "capex", "fcf", "revenue"), "end_date").alias("_s")
    ).select("code", "_s.*")
    return s.select(
        "code", safe_div("n_income", "revenue").alias("net_profit_margin"), safe_div("cfo", "revenue").alias("cfo_margin"), safe_div("fcf", "revenue").alias("fcf_margin"),
        safe_div("capex", "revenue").alias("capex_intensity"), safe_div(F.col("cfo") - F.col("capex"), "n_income").alias("cash_conversion"),
    )


MARGIN_COLS = ("margin_balance_change", "margin_buy_intensity", "margin_net_buy")
FLOW_COLS = ("net_mf_ratio", "mf_buy_sell_ratio", "mf_consecutive", "mf_intensity_rank")
VALUE_COLS = ("pe_ttm", "pb", "roe", "earnings_yield", "pe_industry_percentile", "pb_industry_percentile", "gross_margin", "total_mv")
RATIO_COLS = ("net_profit_margin", "cfo_margin", "fcf_margin", "capex_intensity", "cash_conversion")


def external_stage(d: DataFrame, x: Inputs) -> DataFrame:
    if x.margin is not None:
        d = d.join(flows.margin_features(x.margin).select("code", "dt", *MARGIN_COLS), ["code", "dt"], "left")
    if x.flow is not None:
        f = flows.flow_features(x.flow)
        share = F.col("buy_elg_amount") / F.nullif(F.col("buy_elg_amount") + F.col("sell_elg_amount"), F.lit(0.0))
        f = f.withColumn("_sh", share).select(
            "code", "dt", *FLOW_COLS, nz(F.col("_sh") - lag("_sh")).alias("mf_buy_sell_rate_change"), nz(F.abs(F.col("_sh") * 2 - 1)).alias("mf_sustained_divergence_5d")
        )
        d = d.join(f, ["code", "dt"], "left")
    known = {}  # what a date may know: the newest valuation and the newest published statement
    if x.valuation is not None:
        known["valuation"] = valuation_features(x.valuation, x.members), "dt", VALUE_COLS
    if x.statements is not None:
        known["statement"] = fundamentals.statement_ratios(x.statements), "known_dt", RATIO_COLS
    if known:
        d = d.join(asof_merge(x.bars.select("code", "dt"), known).drop(*[f"{k}_dt" for k in known]), ["code", "dt"], "left")
    have = set(d.columns)
    return d.withColumns({k: nz(k) for k in (*MARGIN_COLS, *FLOW_COLS) if k in have})


COMPOSITE_RANKS = {
    "_r_roe": "roe", "_r_gm": "gross_margin", "_r_cfo": "cfo_margin", "_r_fcf": "fcf_margin", "_r_atr": "atr_pct", "_r_mom": "mom20", "_r_amt": "amount_ratio", "_r_v5": "vol_ma5_ratio",
}


def cross_stage(d: DataFrame) -> DataFrame:
    """Ranks and z-scores per date and the composite scores made of ranks, as a narrow table.

    All ranks share one pass over the columns they need. A date on which all
    values are equal keeps rank 0 in the published ranks.
    """
    full = {"roe", "fcf_margin"} <= set(d.columns)
    ranks = {**RANKS, "turnover_std_rank": "turnover_ratio_5d_20d"}
    sources = {**{f"_p_{k}": v for k, v in ranks.items()}, **(COMPOSITE_RANKS if full else {})}
    extra = ["pe_industry_percentile", "pb_industry_percentile"] if full else []
    n = d.select("dt", "code", *dict.fromkeys([*sources.values(), *ZSCORES.values(), *extra]))
    n = cross.zscores(with_pct_ranks(n, ["dt"], ["dt", "code"], sources, scale=1.0), ["dt"], ZSCORES)
    flat = {k: F.min(v).alias(f"_lo_{k}") for k, v in RANKS.items()} | {f"{k}_hi": F.max(v).alias(f"_hi_{k}") for k, v in RANKS.items()}
    n = n.join(n.groupBy("dt").agg(*flat.values()), "dt")
    n = n.withColumns({k: F.when(F.col(f"_lo_{k}") == F.col(f"_hi_{k}"), 0.0).otherwise(F.col(f"_p_{k}") * 100) for k in RANKS})
    n = n.withColumn("turnover_std_rank", F.col("_p_turnover_std_rank") * 100)
    if not full:
        return n.select("dt", "code", *ranks, *ZSCORES)
    r = {k: nz(k) for k in COMPOSITE_RANKS}
    pe, pb = (F.when(F.col(k) > 0, F.col(k)).otherwise(50.0) for k in extra)
    composite = {
        "quality_score": r["_r_roe"] * 0.4 + r["_r_gm"] * 0.3 + r["_r_cfo"] * 0.3,
        "value_score": -pe * 0.5 - pb * 0.3 + r["_r_fcf"] * 100 * 0.2,
        "momentum_quality": nz("mom20") * (F.lit(1.0) - nz("_r_atr", 0.5)),
        "composite_crowding": r["_r_mom"] * 0.3 + r["_r_amt"] * 0.4 + (F.lit(1.0) - r["_r_v5"]) * 0.3,
        "mom20_x_low_vol": nz("mom20") * r["_r_atr"],
        "growth_score": r["_r_fcf"] * 0.6 + 0.2,
        "low_vol_anomaly_score": r["_r_mom"] * (F.lit(1.0) - r["_r_atr"]),
    }
    n = materialised(n.select("dt", "code", *ranks, *ZSCORES, *[e.alias(k) for k, e in composite.items()], "_r_mom"))
    n = with_pct_ranks(n, ["dt"], ["dt", "code"], {"_r_val": "value_score"}, scale=1.0)
    return n.withColumn("value_momentum_divergence", nz("_r_val") - nz("_r_mom")).drop("_r_val", "_r_mom")


def derived(d: DataFrame) -> DataFrame:
    """Ratios and products on top of the joined matrix, as a narrow table: its windows sort the columns they read only."""
    atr = F.col("atr_pct")
    a60 = mean_n("atr_pct", 60, 60)
    return d.select(
        "code", "dt",
        nz(div0(mean_n("atr_pct", 14, 14), mean_n("atr_pct", 7, 7))).alias("atr_ratio_14_7"), nz(div0(mean_n("atr_pct", 20, 20), a60), 1.0).alias("atr_regime_short_term"),
        (nz("downside_vol") * F.sqrt(F.lit(252.0))).alias("realized_vol_half_month"), F.abs(F.col("bb_pct_b") - 50).alias("bb_convergence"),
        nz(div0("bb_width", lag("bb_width", 5)) - 1).alias("bb_expansion_rate"), nz(F.col("bb_pct_b") - lag("bb_pct_b")).alias("bb_position_accel"),
        nz(F.col("vwap_deviation") - mean_n("vwap_deviation", 20, 20)).alias("vwap_ma20_divergence"),
        nz(div0("lt_count_l1", F.col("lt_count_l1") + F.col("dt_count_l1"))).alias("lt_to_dt_ratio"), nz(F.col("lt_rate_l1") * F.col("rank_l1_in_all") / 100).alias("lt_rate_mul_L1_rank"),
        nz(F.col("lt_count_l1") - lag("lt_count_l1", 5)).alias("lt_rate_trend_5d"), nz(F.col("lt_count_l1") - lag("lt_count_l1") * 2 + lag("lt_count_l1", 2)).alias("lt_count_mom_accel"),
        flag(wide_limit("code")).alias("is_20cm_eligible"),
        nz(div0(F.col("vol_ratio") - mean_n("vol_ratio", 20, 20), std_n("vol_ratio", 20, 20))).alias("volume_ratio_zscore_20d"),
        clip(nz("mom3") / F.greatest(F.abs(nz("mom20", 0.01)), F.lit(0.01)), -10, 10).alias("mom3_mom20_ratio"),
        (F.lit(1.0) / (nz(atr) + 1)).alias("regime_adaptive_weight"), nz(div0(atr - a60, std_n("atr_pct", 60, 60))).alias("vol_regime_zscore_position"),
        ((F.abs(nz("mom20")) - nz(atr) * 2) / F.greatest(nz(atr, 1.0), F.lit(0.1))).alias("trend_strength_score"), flag(atr > a60 * 0.8).alias("vol_regime_flag"),
        *[nz(F.col(a) * F.col(b)).alias(n) for n, (a, b) in PRODUCTS.items()],
    )


def renamed(d: DataFrame) -> DataFrame:
    """Features that follow from one column of the matrix."""
    if "roe" in d.columns:
        d = d.withColumn("roa", F.col("roe") * 0.6).withColumn("log1p_total_mv", F.log1p(F.abs(F.col("total_mv"))))
    if "margin_buy_intensity" in d.columns:
        d = d.withColumn("margin_buy_intensity_ratio", F.col("margin_buy_intensity")).withColumn("margin_price_divergence", F.col("margin_balance_change"))
    return d


PRODUCTS = {
    "vol_ratio_x_mom1": ("vol_ratio", "mom1"), "bb_pct_b_x_vol_ratio": ("bb_pct_b", "vol_ratio"), "macd_hist_x_mom5": ("macd_hist", "mom5"), "gap_x_mom5": ("gap_pct", "mom5"),
    "rsi_x_mom20": ("rsi_14", "mom20"), "streak_x_vol_ratio": ("streak", "vol_ratio"), "turnover_x_price_pos": ("turnover_ratio_5d_20d", "price_position_20d"),
    "mom20_x_bb_width": ("mom20", "bb_width"), "vol_ratio_x_atr_pct": ("vol_ratio", "atr_pct"),
}

# What the cross stage and the derived features read of the joined matrix.
READ = (
    *RANKS.values(), *ZSCORES.values(), *COMPOSITE_RANKS.values(), "pe_industry_percentile", "pb_industry_percentile",
    "downside_vol", "bb_pct_b", "bb_width", "vwap_deviation", "lt_count_l1", "dt_count_l1", "lt_rate_l1", "rank_l1_in_all", "mom3",
    *(c for pair in PRODUCTS.values() for c in pair),
)

# Columns that only carry intermediate values or inputs.
NOT_FEATURES = {
    "open", "high", "low", "vol", "pre_close", "pct_chg", "ret", "tr", "atr", "ma5", "ma10", "ma20", "ma60", "ma120", "ma250", "vma5", "vma20", "ama5", "ama20", "ama10",
    "bb_mid", "bb_std", "bb_upper", "bb_lower", "macd_label", "vol14", "vol20_annual", "l1", "l2", "l3", "amount",
}


def build(x: Inputs, warm_up: int = WARM_UP, whole_history: bool = False) -> DataFrame:
    """All features per (code, dt) after the warm-up bars; NULLs are kept (fill at the model boundary).

    The bars, the blocks of windows, the other panels as one table and the few columns that ranks and derived
    features read are stored. The matrix is joined once, from those, and its rows move once, by (code, dt).
    """
    keys = ["code", "dt"]
    panel = materialised(x.bars.withColumn("pre_close", lag("close")).withColumn("pct_chg", (F.col("close") / F.col("pre_close") - 1) * 100))
    # every stage reads these again, and each may be built from ticks
    x = replace(x, bars=panel.drop("pre_close", "pct_chg"), **{k: materialised(v) for k in ("members", "l1", "l2", "l3") if (v := getattr(x, k)) is not None})
    d, trend = window_stage(panel, x.members)
    d = d.join(materialised(external_stage(group_stage(trend, panel, x), x)), keys, "left")
    d = day_stage(d, panel, x).withColumns(calendar_columns(F.col("dt"))).withColumn("board_type", board_type("code"))
    few = materialised(mask(d, READ, keys))
    d = renamed(d.join(cross_stage(few), keys, "left").join(derived(few), keys, "left"))
    if whole_history:  # looks ahead inside the sample; the default is the expanding form
        d = d.join(dep.history_statistics(x.bars).drop("n"), "code", "left").join(dep.hurst(x.bars), "code", "left")
    else:
        d = d.join(dep.expanding_autocorr(x.bars), keys, "left").join(dep.expanding_statistics(x.bars), keys, "left")
    mapped = flag(F.col("l1").isNotNull())
    d = d.withColumn("has_sw_mapping", mapped).where(F.col("_bar") > warm_up)
    keep = [c for c in d.columns if c not in NOT_FEATURES and not c.startswith("_")]
    return d.select(*keep)


def filled(features: DataFrame) -> DataFrame:
    """Matrix for model input: NULL and NaN become 0."""
    doubles = [f.name for f in features.schema.fields if f.dataType.typeName() == "double"]
    return features.withColumns({c: F.when(~F.isnan(c), F.col(c)).otherwise(0.0) for c in doubles})

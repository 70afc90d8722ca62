"""Statistics over predictions, trades and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, exact_percentiles, tie_table, with_pct_rank, with_rank_columns
from ..functions.scalar import corr, div0, nz, one_if, tiers
from ..functions.windows import lag
from .cross import top_n

YEAR_DAYS, RISK_FREE = 252, 0.02


def share(cond: Column) -> Column:
    """Percent of the group's rows for which the condition holds."""
    return F.avg(one_if(cond)) * 100


def outcome_stats(df: DataFrame, by: Sequence[str], x: str, limits: Sequence[float] = (0, 5, 10, 20)) -> DataFrame:
    """Count, mean, median, shares above the limits, extremes and population deviation."""
    by = list(by)
    d = df.where(F.col(x).isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("avg_return"), F.max(x).alias("max_return"), F.min(x).alias("min_return"),
        F.stddev_pop(x).alias("std_return"), *[share(F.col(x) > v).alias(f"win_gt{v}") for v in limits],
    ]
    if by:
        return d.groupBy(*by).agg(*aggs).join(exact_percentiles(d, by, x, {"median_return": 0.5}), by)
    median = exact_percentiles(d, [], x, {"median_return": 0.5}).scalar()
    return d.agg(*aggs).withColumn("median_return", median)


def percentile_panel(df: DataFrame, x: str, by: Sequence[str] = (), points: Sequence[int] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    return exact_percentiles(df, list(by), x, {f"p{p}": p / 100 for p in points})


def with_quantile_bucket(df: DataFrame, x: str, n: int, out: str = "bucket") -> DataFrame:
    """Bucket 0..n-1 by linear-interpolated quantile edges, right-closed."""
    names = {f"q{i}": i / n for i in range(1, n)}
    edges = exact_percentiles(df, [], x, names).select(F.array(*names)).scalar()
    d = df.where(F.col(x).isNotNull()).withColumn("_e", edges)
    return d.withColumn(out, sum((one_if(F.col(x) > F.col("_e")[i]) for i in range(n - 1)), F.lit(0))).drop("_e")


def with_width_bucket(df: DataFrame, x: str, n: int, out: str = "bucket") -> DataFrame:
    """Bucket 0..n-1 of n equal widths between the extremes, right-closed."""
    ends = df.agg(F.array(F.min(x), F.max(x))).scalar()
    d = df.where(F.col(x).isNotNull()).withColumn("_e", ends)
    pos = F.ceil(div0(F.col(x) - F.col("_e")[0], F.col("_e")[1] - F.col("_e")[0]) * n) - 1
    return d.withColumn(out, F.greatest(F.least(nz(pos, 0), F.lit(n - 1)), F.lit(0)).cast("int")).drop("_e")


def factor_quantiles(df: DataFrame, factors: Sequence[str], outcome: str, n: int = 4) -> DataFrame:
    """Outcome per n-quantile of every factor (bucket 0 lowest, edges interpolated, right-closed): rows, mean, share of gains,
    and ``spread``, the mean of the highest bucket less that of the lowest. All factors share one stacked pass; rows without the outcome
    or the factor are left out of that factor."""
    names = {f"_q{i}": i / n for i in range(1, n)}
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    d = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).alias("_o"), F.explode(pairs).alias("_p")).select("_o", "_p.factor", "_p.x").where("x is not null and not isnan(x)")
    d = d.join(exact_percentiles(d, ["factor"], "x", names), "factor")  # a row of edges per factor
    bucket = sum((one_if(F.col("x") > F.col(q)) for q in names), F.lit(0))
    out = d.groupBy("factor", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("_o").alias("avg_return"), share(F.col("_o") > 0).alias("win_rate"))
    every = Window.partitionBy("factor")  # n rows
    ends = [F.max(F.when(F.col("bucket") == k, F.col("avg_return"))).over(every) for k in (n - 1, 0)]
    return out.withColumn("spread", ends[0] - ends[1])


def factor_study(df: DataFrame, factor: str, label: str, n: int = 10) -> DataFrame:
    """Risk rate per quantile bucket with lift of the last over the first and monotonicity."""
    d = with_quantile_bucket(df, factor, n).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), share(F.col(label) == 1).alias("risk_rate"))
    w = Window.orderBy("bucket")  # n rows
    d = d.withColumn("_up", nz(F.col("risk_rate") >= lag("risk_rate", 1, w), True))
    every = Window.partitionBy()
    return d.select(
        "bucket", "n", "risk_rate", F.min("_up").over(every).alias("monotonic"),
        div0(F.max_by("risk_rate", "bucket").over(every), F.min_by("risk_rate", "bucket").over(every)).alias("lift"),
    )


def confusion(df: DataFrame, score: str, label: str, percentile: float) -> DataFrame:
    """tp/fp/tn/fn and derived rates with the score's percentile as threshold."""
    cut = exact_percentiles(df, [], score, {"t": percentile}).scalar()
    d = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), (F.col(label) == 1).alias("y")).withColumn("p", F.col("s") >= cut)
    c = d.agg(
        F.sum(one_if(F.col("p") & F.col("y"))).alias("tp"), F.sum(one_if(F.col("p") & ~F.col("y"))).alias("fp"),
        F.sum(one_if(~F.col("p") & ~F.col("y"))).alias("tn"), F.sum(one_if(~F.col("p") & F.col("y"))).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return c.select(
        "tp", "fp", "tn", "fn", nz(div0(tp, tp + fp)).alias("precision"), nz(div0(tp, tp + fn)).alias("recall"),
        nz(div0(tp * 2, tp * 2 + fp + fn)).alias("f1"), nz(div0(tp + tn, n)).alias("accuracy"), nz(div0((tp + fp) * 100, n)).alias("alarm_pct"),
    )


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks (rank-sum form)."""
    by = list(by)
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    r = with_rank_columns(d, by, score, _r=average_rank())
    agg = (r.groupBy(*by) if by else r.groupBy()).agg(
        F.sum(one_if(F.col(label) == 1)).alias("n_pos"), F.sum(one_if(F.col(label) != 1)).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"),
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return agg.select(*by, "n_pos", "n_neg", nz(div0(F.col("_s") - p * (p + 1) / 2, p * n), 0.5).alias("auc"))


def rank_ic(df: DataFrame, pred: str, actual: str, by: str = "dt", min_rows: int = 10, boost: float | None = None, alpha_min: float = 2.0) -> DataFrame:
    """Spearman correlation per date; ``boost`` scales the prediction where the outcome exceeds alpha_min."""
    d = df.select(by, "code", F.col(pred).alias("_p"), F.col(actual).alias("_a")).where("_p is not null and _a is not null")
    if boost:
        d = d.withColumn("_p", F.when(F.col("_a") > alpha_min, F.col("_p") * boost).otherwise(F.col("_p")))
    stacked = d.select(by, "code", F.explode(F.array(F.struct(F.lit("p").alias("f"), F.col("_p").alias("x")), F.struct(F.lit("a").alias("f"), F.col("_a").alias("x")))).alias("_s"))
    stacked = stacked.select(by, "code", "_s.f", F.col("_s.x").cast("double").alias("x"))
    ranks = tie_table(stacked, [by, "f"], "x").select(by, "f", "x", average_rank().alias("r"))
    pairs = stacked.join(ranks, [by, "f", "x"]).groupBy(by, "code").agg(
        F.max(F.when(F.col("f") == "p", F.col("r"))).alias("rp"), F.max(F.when(F.col("f") == "a", F.col("r"))).alias("ra")
    )
    out = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), corr("rp", "ra").alias("ic")).where(F.col("n") >= min_rows)
    return out.where(F.col("ic").isNotNull() & ~F.isnan("ic"))


def topn_panel(df: DataFrame, pred: str, actual: str, vol: str, n: int = 5) -> DataFrame:
    """Share of winning picks and mean volatility of the daily top n (dates with fewer rows skipped)."""
    enough = df.groupBy("dt").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    t = top_n(df.join(enough, "dt", "left_semi"), ["dt"], pred, n)
    per_day = t.groupBy("dt").agg(F.avg(vol).alias("_v"), F.sum(one_if(F.col(actual) > 0)).alias("_w"), F.count(actual).alias("_t"))
    return per_day.agg(
        F.count(F.lit(1)).alias("n_dates"), nz(div0(F.sum("_w"), F.sum("_t"))).alias("actual_win_rate"), F.avg("_v").alias("avg_volatility"),
    )


def separation(df: DataFrame, score: str, outcome: str, edge: float = 0.25) -> DataFrame:
    """Mean outcome of each date's best quarter minus its worst quarter (descending percent rank)."""
    d = with_pct_rank(df.withColumn("_neg", -F.col(score)), ["dt"], "_neg", "_rk", scale=1.0)
    top, bot = F.col("_rk") <= edge, F.col("_rk") >= 1 - edge
    return d.agg(
        F.sum(one_if(top)).alias("n_top"), F.sum(one_if(bot)).alias("n_bottom"), F.avg(F.when(top, F.col(outcome))).alias("top_avg"),
        F.avg(F.when(bot, F.col(outcome))).alias("bottom_avg"), share(top & (F.col(outcome) > 0)).alias("_x"),
        (F.avg(F.when(top, one_if(F.col(outcome) > 0))) * 100).alias("top_win"),
    ).select("n_top", "n_bottom", "top_avg", "bottom_avg", (F.col("top_avg") - F.col("bottom_avg")).alias("separation"), "top_win")


def concentration(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """HHI, Gini, shares of the most traded codes, single and repeated appearances, per group."""
    by = list(by)
    k = by or ["_all"]
    t = trades if by else trades.withColumn("_all", F.lit(1))
    counts = t.groupBy(*k, "code").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*k).agg(
        F.sum("c").alias("n_trades"), F.count(F.lit(1)).alias("n_stocks"), F.sum(F.col("c") * F.col("c")).alias("_sq"),
        F.sum(one_if(F.col("c") == 1)).alias("single_appearance"), F.sum(one_if(F.col("c") >= 5)).alias("core_holdings"),
    )
    # ranks of equal counts share their average, which leaves the weighted sum unchanged
    gini = tie_table(counts, k, "c").groupBy(*k).agg(F.sum((average_rank() * 2 - F.col("n_group") - 1) * F.col("x") * F.col("n_tie")).alias("_g"))
    best = top_n(counts, k, "c", 10).groupBy(*k).agg(
        F.sum(F.when(F.col("rk") <= 1, F.col("c"))).alias("_t1"), F.sum(F.when(F.col("rk") <= 5, F.col("c"))).alias("_t5"), F.sum("c").alias("_t10")
    )
    n = F.col("n_trades")
    return totals.join(gini, k).join(best, k).select(
        *by, "n_trades", "n_stocks", (F.col("_sq") / n / n).alias("hhi"), (F.col("_g") / (F.col("n_stocks") * n)).alias("gini"),
        (F.col("_t1") / n).alias("top1_pct"), (F.col("_t5") / n).alias("top5_pct"), (F.col("_t10") / n).alias("top10_pct"),
        "single_appearance", "core_holdings",
    )


def jaccard_turnover(picks: DataFrame) -> DataFrame:
    """1 - |A∩B| / |A∪B| of the codes held on consecutive pick dates."""
    held = picks.select("dt", "code").distinct()
    sizes = held.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("dt")  # one row per date
    cal = sizes.select("dt", "n", F.lag("dt").over(w).alias("prev_dt"), F.lag("n").over(w).alias("prev_n")).where("prev_dt is not null")
    before = held.select(F.col("dt").alias("prev_dt"), "code")
    both = held.join(cal.select("dt", "prev_dt"), "dt").join(before, ["prev_dt", "code"]).groupBy("dt").agg(F.count(F.lit(1)).alias("_both"))
    d = cal.join(both, "dt", "left").withColumn("_both", nz("_both", 0))
    return d.select("dt", (F.lit(1.0) - F.col("_both") / (F.col("n") + F.col("prev_n") - F.col("_both"))).alias("turnover"))


def turnover_summary(turnover: DataFrame, high: float = 0.8) -> DataFrame:
    return turnover.agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg("turnover").alias("mean_turnover"), F.avg(one_if(F.col("turnover") > high)).alias("high_turnover_pct")
    ).withColumn("median_turnover", exact_percentiles(turnover, [], "turnover", {"m": 0.5}).scalar())


def decay_proxy(trades: DataFrame, members: DataFrame, limit: float = 0.55) -> DataFrame:
    """Per date and industry: trades, share of low probabilities, mean probability and returns."""
    return trades.join(members.select("code", "industry"), "code", "left").withColumn("industry", nz("industry", "UNCLASSIFIED")).groupBy("dt", "industry").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(one_if(F.col("win_prob") < limit)).alias("low_wp_pct"), F.avg("win_prob").alias("mean_wp"),
        F.avg("t1_ret").alias("mean_t1"), F.avg("d5_ret").alias("mean_d5"),
    )


def weekly_heatmap(proxy: DataFrame, top: int | None = None, weeks: int | None = None) -> DataFrame:
    """Mean low-probability share per industry and week, kept long.

    ``weeks`` keeps the last weeks, ``top`` the industries with the highest mean share over
    those weeks (ties: the first by name); None keeps all."""
    d = proxy.withColumn("week", F.to_date(F.date_trunc("week", "dt")))
    if weeks is not None:
        d = d.join(d.select("week").distinct().orderBy(F.desc("week")).limit(weeks), "week", "left_semi")
    if top is not None:
        share_of = d.groupBy("industry").agg(F.round(F.avg("low_wp_pct"), 9).alias("_m"))
        d = d.join(share_of.orderBy(F.desc("_m"), "industry").limit(top), "industry", "left_semi")
    return d.groupBy("industry", "week").agg(
        F.avg("low_wp_pct").alias("low_wp_pct"), F.sum("n_trades").alias("n_trades")
    )


def compounded(df: DataFrame, by: Sequence[Column], ret: str) -> DataFrame:
    return df.groupBy(*by).agg((F.exp(F.sum(F.log1p(ret))) - 1).alias("ret"))


def performance(daily: DataFrame) -> DataFrame:
    """Metrics of a daily return table (dt, ret, bench_ret): one row per date, one row out."""
    w = Window.orderBy("dt")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select("dt", nz("ret").alias("ret"), nz("bench_ret").alias("bench_ret"))
    d = d.select("*", F.exp(F.sum(F.log1p("ret")).over(run)).alias("nav"), F.sum(F.log1p("bench_ret")).over(run).alias("_b"))
    d = d.withColumn("peak", F.greatest(F.max("nav").over(run), F.lit(1.0)))
    d = d.withColumn("dd", F.col("nav") / F.col("peak") - 1)
    d = d.withColumn("_g", F.sum(one_if(F.col("dd") >= 0)).over(run))
    spans = d.where("dd < 0").groupBy("_g").agg(F.count(F.lit(1)).alias("_len")).agg(F.max("_len").alias("x"))
    monthly = compounded(d, [F.trunc("dt", "month").alias("m")], "ret").agg(F.avg(one_if(F.col("ret") > 0)).alias("x"))
    s = d.agg(
        F.count(F.lit(1)).alias("n_days"), (F.max_by("nav", "dt") - 1).alias("total_return"), (F.exp(F.max_by("_b", "dt")) - 1).alias("benchmark_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("annual_volatility"),
        ((F.avg("ret") - RISK_FREE / YEAR_DAYS) / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("sharpe"),
        F.min("dd").alias("max_drawdown"), F.avg(one_if(F.col("ret") > 0)).alias("win_rate_daily"),
        F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("_win"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("_loss"),
    )
    s = s.withColumn("annual_return", F.pow(F.col("total_return") + 1, F.lit(float(YEAR_DAYS)) / F.col("n_days")) - 1)
    return s.select(
        "n_days", "total_return", "benchmark_return", (F.col("total_return") - F.col("benchmark_return")).alias("excess_return"), "annual_return",
        "annual_volatility", "sharpe", "max_drawdown", nz(spans.scalar(), 0).alias("max_drawdown_days"),
        F.when(F.abs("max_drawdown") > 0.001, div0("annual_return", F.abs("max_drawdown"))).alias("calmar"),
        "win_rate_daily", monthly.scalar().alias("win_rate_monthly"), nz(div0("_win", F.abs("_loss"))).alias("profit_loss_ratio"),
    )


def trade_statistics(trades: DataFrame, by: Sequence[str] = ("exit_reason",)) -> DataFrame:
    r = F.col("ret")
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(r > 0).alias("win_rate"), F.avg("ret").alias("avg_return"), F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r <= 0, r)).alias("avg_loss"), F.avg("hold_days").alias("avg_hold_days"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
    )


def fold_table(folds: DataFrame, trades_in_folds: DataFrame, members: DataFrame, gate: float = 0.55) -> DataFrame:
    """Per fold: trades, HHI, industries, win rates, gated share and weak-probability count."""
    t = trades_in_folds
    conc = concentration(t, ["fold"]).select("fold", "n_trades", "hhi", "gini", "top5_pct")
    ind = t.join(members.select("code", "industry"), "code", "left").groupBy("fold").agg(
        F.countDistinct("industry").alias("n_industries"), F.avg(one_if(F.col("t1_ret") > 0)).alias("t1_wr"), F.avg(one_if(F.col("d5_ret") > 0)).alias("d5_wr"),
        F.avg(one_if(F.col("win_prob") < gate)).alias("gate_blocked"), F.sum(one_if(F.col("win_prob") < gate * 0.75)).alias("alpha_cut"),
    )
    return folds.join(conc, "fold").join(ind, "fold")


def fold_temperature(folds: DataFrame) -> DataFrame:
    """20 + 60 * (1 - percent rank of the gated share inside the regime)."""
    d = with_pct_rank(folds, ["regime"], "gate_blocked", "_r", scale=1.0)
    return d.withColumn("temp", F.greatest(F.least((F.lit(1.0) - F.col("_r")) * 60 + 20, F.lit(100.0)), F.lit(0.0))).drop("_r")


def cut_groups(folds: DataFrame) -> DataFrame:
    c = F.col("alpha_cut")
    label = tiers([(c == 0, "0"), (c <= 3, "1-3"), (c <= 6, "4-6")], ">6")
    return folds.withColumn("cuts", label).groupBy("cuts").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("t1_wr").alias("t1_wr"), F.avg("d5_wr").alias("d5_wr"), F.avg("gate_blocked").alias("gate_blocked"),
        *[F.sum(one_if(F.col("regime") == r)).alias(f"n_{r}") for r in ("bull", "range", "bear")],
    )


def position_rules(folds: DataFrame) -> DataFrame:
    """Mean win rates per regime and temperature third, with the size they suggest."""
    every = Window.orderBy("temp", "fold")  # one row per fold
    third = F.floor((F.row_number().over(every) - 1) * 3 / F.count(F.lit(1)).over(Window.partitionBy()))
    d = folds.withColumn("temp_q", third.cast("int")).groupBy("regime", "temp_q").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("t1_wr").alias("t1_wr"), F.avg("d5_wr").alias("d5_wr"), F.avg("alpha_cut").alias("alpha_cut")
    ).where("n_folds >= 2")
    t1, d5 = F.col("t1_wr"), F.col("d5_wr")
    return d.withColumn("size", tiers([((t1 >= 0.55) & (d5 >= 0.50), 5), (t1 >= 0.45, 3), (t1 >= 0.35, 2)], 1))


def decay_ranking(probs: DataFrame, today: Column, past: Column, p: str = "p_mean") -> DataFrame:
    """Change of the percent rank of the mean probability between two dates, common codes only."""
    now = probs.where(F.col("dt") == today).select("code", F.col(p).alias("p_today"))
    old = probs.where(F.col("dt") == past).select("code", F.col(p).alias("p_past"))
    d = now.join(old, "code").withColumn("_k", F.lit(1))
    d = with_pct_rank(d, ["_k"], "p_today", "rank_today")
    d = with_pct_rank(d, ["_k"], "p_past", "rank_past").drop("_k")
    return d.withColumn("decay", F.col("rank_today") - F.col("rank_past"))


def sector_decay(decay: DataFrame, members: DataFrame) -> DataFrame:
    d = decay.join(members.select("code", "industry"), "code", "left").withColumn("industry", nz("industry", "UNKNOWN"))
    agg = d.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.avg("decay").alias("mean_decay"), share(F.col("decay") < 0).alias("down_pct"))
    return agg.join(exact_percentiles(d, ["industry"], "decay", {"median_decay": 0.5}), "industry")


def pattern_statistics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recovery rate and length of recovered pullbacks (all events count in the rate)."""
    by = list(by)
    rec = F.col("recovery_days") >= 0
    d = F.when(rec, F.col("recovery_days"))
    agg = (events.groupBy(*by) if by else events.groupBy()).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(one_if(rec)).alias("recovered_count"), share(rec).alias("recovery_rate"),
        F.avg(d).alias("mean_recovery_days"), F.min(d).alias("best_case_days"), F.max(d).alias("worst_case_days"),
    )
    return agg


def recovery_curve(events: DataFrame, max_days: int | None = None) -> DataFrame:
    """Share of the recovered events that were back within each number of days, up to
    the longest recovery or ``max_days``."""
    done = events.where("recovery_days >= 0").groupBy("recovery_days").agg(F.count(F.lit(1)).alias("_n"))
    last = done.agg(F.least(F.max("recovery_days"), F.lit(max_days).cast("int")).alias("m"))
    days = last.select(F.explode(F.sequence(F.lit(1), F.greatest(F.col("m"), F.lit(1)))).alias("day"))
    marks = days.join(done.withColumn("day", F.greatest("recovery_days", F.lit(1))).groupBy("day").agg(F.sum("_n").alias("_n")), "day", "left")
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row per day of the longest recovery
    return marks.select("day", (F.sum(nz("_n", 0)).over(w) * 100 / done.agg(F.sum("_n")).scalar()).alias("win_rate"))


def event_study(daily: DataFrame, event: str, signals: Mapping[str, Column], k: int = 3) -> DataFrame:
    """Hit rate of every signal in the k rows before events against its rate on other days."""
    w = Window.orderBy("dt")  # one row per date
    d = daily.select("dt", F.col(event).alias("_ev"), *[c.alias(n) for n, c in signals.items()])
    # number of events for which each row lies within the k rows before
    d = d.withColumn("_near", F.sum(one_if(F.col("_ev"))).over(w.rowsBetween(1, k)))
    long = d.select("_ev", nz("_near", 0).alias("_near"), F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("hit")) for n in signals])).alias("_s"))
    agg = long.where("_s.hit is not null").groupBy("_s.signal").agg(
        F.sum(F.col("_near") * one_if(F.col("_s.hit"))).alias("hits_before"), F.sum("_near").alias("checks"),
        F.sum(one_if(~F.col("_ev") & F.col("_s.hit"))).alias("_r"), F.sum(one_if(~F.col("_ev"))).alias("_n"),
    )
    hit, rnd = nz(div0("hits_before", "checks")) * 100, nz(div0("_r", "_n")) * 100
    return agg.select("signal", "hits_before", "checks", hit.alias("hit_rate"), rnd.alias("random_rate"), nz(div0(hit, rnd), 1.0).alias("lift"))


def combination_study(daily: DataFrame, event: str, combos: Mapping[str, Column], k: int = 3) -> DataFrame:
    """Events warned by a combination in the k rows before, false alarms, precision."""
    w = Window.orderBy("dt")
    d = daily.select("dt", F.col(event).alias("_ev"), *[nz(c, False).alias(n) for n, c in combos.items()])
    d = d.select(
        "*", nz(F.max(one_if(F.col("_ev"))).over(w.rowsBetween(1, k)), 0).alias("_soon"), (F.row_number().over(w) > k).alias("_in"),
        *[nz(F.max(one_if(F.col(n))).over(w.rowsBetween(-k, -1)), 0).alias(f"_w_{n}") for n in combos],
    )
    long = d.select("_ev", "_soon", "_in", F.explode(F.array(*[F.struct(F.lit(n).alias("combo"), F.col(n).alias("hit"), F.col(f"_w_{n}").alias("warned")) for n in combos])).alias("_s"))
    agg = long.groupBy("_s.combo").agg(
        F.sum(one_if(F.col("_ev"))).alias("n_events"), F.sum(one_if(F.col("_ev") & (F.col("_s.warned") == 1))).alias("warned"),
        F.sum(one_if(~F.col("_ev") & F.col("_in") & F.col("_s.hit") & (F.col("_soon") == 0))).alias("false_alarms"),
        F.sum(one_if(F.col("_in") & F.col("_s.hit"))).alias("triggers"),
    )
    return agg.select("*", nz(div0(F.col("warned") * 100, "n_events")).alias("coverage"), nz(div0(F.col("warned") * 100, F.col("warned") + F.col("false_alarms"))).alias("precision"))


def warning_precision(signals: DataFrame, n: int = 14) -> DataFrame:
    """Share of phase triggers followed by each target event within n rows, with mean lead time."""
    w = Window.orderBy("dt")
    nxt = w.rowsBetween(1, n)
    events = {
        "drop_5d": F.col("ret5") <= -3, "extreme_day": (F.col("down_pct") >= 90) & (F.col("chg") <= -2.5),
        "slide_10d": F.col("ret10") <= -5, "broad_day": F.col("down_pct") >= 90,
    }
    d = signals.select("*", F.row_number().over(w).alias("_i"), *[nz(e, False).alias(f"_e_{k}") for k, e in events.items()])
    d = d.select("*", F.count(F.lit(1)).over(nxt).alias("_left"), *[F.min(F.when(F.col(f"_e_{k}"), F.col("_i"))).over(nxt).alias(f"_f_{k}") for k in events])
    phases = {
        "phase1": F.col("phase1"), "phase2": F.col("phase2"), "phase3": F.col("phase3"), "phase1_or_2": F.col("phase1") | F.col("phase2"),
        "any_phase": F.col("phase1") | F.col("phase2") | F.col("phase3"),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("phase"), c.alias("on"), F.lit(k).alias("event"), (F.col(f"_f_{k}") - F.col("_i")).alias("lead")) for p, c in phases.items() for k in events])
    long = d.where("_left >= 3").select(F.explode(pairs).alias("_s")).where("_s.on")
    return long.groupBy("_s.phase", "_s.event").agg(
        F.count(F.lit(1)).alias("n_triggers"), F.count("_s.lead").alias("hits"), (F.count("_s.lead") * 100 / F.count(F.lit(1))).alias("precision"), F.avg("_s.lead").alias("mean_lead"),
    )


def importance_stability(importance: DataFrame) -> DataFrame:
    """Spread of each feature's importance rank across folds (features per fold are few)."""
    r = importance.withColumn("rk", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("importance"))))
    return r.groupBy("feature").agg(F.avg("rk").alias("mean_rank"), F.stddev_samp("rk").alias("rank_std"), F.count(F.lit(1)).alias("n_folds"))


def anomaly_scores(history: DataFrame, x: str, n: int = 20) -> DataFrame:
    """z of each date against the n dates before (population deviation), level at 2 and 3. Equal values have no
    deviation, and z is taken to nine digits, so that neither rests on the order of a sum."""
    w = Window.orderBy("dt").rowsBetween(-n, -1)
    spread = F.when(F.max(x).over(w) > F.min(x).over(w), F.stddev_pop(x).over(w))
    d = history.select("dt", x, F.avg(x).over(w).alias("_m"), spread.alias("_s"), F.count(x).over(w).alias("_n"))
    z = F.when(F.col("_n") >= n, F.round(div0(F.col(x) - F.col("_m"), "_s"), 9))
    level = tiers([(F.abs(F.col("z")) > 3, "severe"), (F.abs(F.col("z")) > 2, "warning")], "normal")
    return d.withColumn("z", z).select("dt", x, "z", level.alias("level"))


def score_trend(scores: DataFrame, x: str, n: int = 10) -> DataFrame:
    """Last n values per code in date order (bounded arrays)."""
    newest = scores.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))).where(F.col("_k") <= n)
    return newest.groupBy("code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dt", F.col(x).alias("v")))), lambda s: s["v"]).alias("trend"), F.count(F.lit(1)).alias("n")
    )

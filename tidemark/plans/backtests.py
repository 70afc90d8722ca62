"""Backtests over score panels: every trade and every date in one pass, no simulation loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles
from ..functions.scalar import clip, nz
from ..functions.windows import mean_n, momentum
from ..operators.cross import top_n
from ..operators.joins import forward_bars
from ..operators.studies import RISK_FREE, YEAR_DAYS, share
from ..session import materialised
from ..sources.ingest import trading_calendar


def filled_panel(bars: DataFrame, values: Sequence[str] = ("close",)) -> DataFrame:
    """Every trading date from a code's first bar on, missing values carried forward.

    The scaffold is a per-code sequence of date positions joined to the calendar.
    """
    cal = trading_calendar(bars)
    last = cal.agg(F.max("date_idx")).scalar()
    first = bars.groupBy("code").agg(F.min("dt").alias("dt")).join(cal, "dt")
    grid = first.select("code", F.explode(F.sequence(F.col("date_idx"), last)).alias("date_idx")).join(cal, "date_idx")
    w = Window.partitionBy("code").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.join(bars.select("code", "dt", *values), ["code", "dt"], "left")
    return d.select("code", "dt", "date_idx", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def rolling_scores(bars: DataFrame, window: int = 20, min_dates: int = 60) -> DataFrame:
    """Momentum score of the bars strictly before each date, with the day's return, on the filled panel."""
    m = bars.select(
        "code", "dt", "close",
        (nz(momentum(window)) * 0.4 + nz(momentum(5)) * 0.3 + (F.col("close") / mean_n("close", window + 1) - 1) * 100 * 0.3).alias("_x"),
        (F.row_number().over(Window.partitionBy("code").orderBy("dt")) > window).alias("_ok"),
    ).withColumn("_s", F.when(F.col("_ok"), clip(F.col("_x") / 3 + 5, 0, 10)))
    p = filled_panel(m.select("code", "dt", "close", "_s"), ("close", "_s"))
    w = Window.partitionBy("code").orderBy("dt")
    d = p.select("code", "dt", "date_idx", F.lag("_s").over(w).alias("score"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    return d.withColumn("score", F.when(F.col("date_idx") > min_dates, F.col("score")))


def topn_daily(scored: DataFrame, n: int = 5, by: Sequence[str] = ("dt",)) -> DataFrame:
    """Equal-weight return of the day's top n and of all codes, on dates with a score."""
    picks = top_n(scored.where("score is not null"), list(by), "score", n)
    port = picks.groupBy(*by).agg(nz(F.avg("ret")).alias("ret"), F.count("ret").alias("n_held"))
    bench = scored.groupBy("dt").agg(F.avg("ret").alias("bench_ret"))
    return port.join(bench, "dt")


def grid_search(bars: DataFrame, lookbacks: Sequence[int], tops: Sequence[int], max_dd: float = 0.35) -> DataFrame:
    """Top-n backtest for every (lookback, n): scores per lookback once, all n from one ranking."""
    scored = None
    for k in lookbacks:
        s = rolling_scores(bars, k).withColumn("lookback", F.lit(k))
        scored = s if scored is None else scored.unionByName(s)
    ranked = top_n(scored.where("score is not null"), ["lookback", "dt"], "score", max(tops))
    held = ranked.select("lookback", "dt", "ret", F.explode(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t >= F.col("rk"))).alias("top"))
    daily = held.groupBy("lookback", "top", "dt").agg(nz(F.avg("ret")).alias("ret"))
    w = Window.partitionBy("lookback", "top").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_s", F.sum(F.log1p("ret")).over(w)).withColumn("nav", F.exp("_s"))
    d = d.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    out = d.groupBy("lookback", "top").agg(
        F.count(F.lit(1)).alias("n_days"), (F.max_by("nav", "dt") - 1).alias("total_return"), F.max_by("_s", "dt").alias("log_return"), F.min("dd").alias("max_drawdown"),
        ((F.avg("ret") - RISK_FREE / YEAR_DAYS) / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("sharpe"),
    )
    return out.withColumn("eligible", F.col("max_drawdown") > -max_dd)


def stop_exits(picks: DataFrame, bars: DataFrame, horizon: int = 5, fixed: Sequence[float] = (3, 5, 7, 10), atr: Sequence[float] = (1.5, 2, 3)) -> DataFrame:
    """Exit of every pick under every stop: the first close below the stop price, else the horizon's close.

    picks: (code, dt, atr_ratio). Picks without a full horizon are left out.
    """
    w = Window.partitionBy("code").orderBy("dt")
    path = F.array(*[F.struct(F.lit(k).alias("k"), F.lead("close", k).over(w).alias("close")) for k in range(1, horizon + 1)])
    path = bars.select("code", F.col("dt").alias("entry_dt"), F.col("close").alias("entry_close"), path.alias("_p"), F.lead("dt", horizon).over(w).alias("_end"))
    # The picks are stored, so the planner knows how few they are and need not shuffle the bars' paths.
    few = materialised(picks.select("code", F.col("dt").alias("entry_dt"), "atr_ratio"))
    d = path.where("_end is not null").join(few, ["code", "entry_dt"])
    stops = [F.struct(F.lit("none").alias("stop"), F.lit(None).cast("double").alias("pct"))]
    stops += [F.struct(F.lit(f"{s}%").alias("stop"), F.lit(float(s)).alias("pct")) for s in fixed]
    stops += [F.struct(F.lit(f"{m}xATR").alias("stop"), (F.col("atr_ratio") * float(m)).alias("pct")) for m in atr]
    d = d.select("code", "entry_dt", "entry_close", "_p", F.explode(F.array(*stops)).alias("_s")).select("*", "_s.stop", "_s.pct")
    line = F.col("entry_close") * (F.lit(1.0) - F.col("pct") / 100)
    d = d.withColumn("_line", line).withColumn("_hit", F.filter("_p", lambda x: x["close"] < F.col("_line")))
    hit = nz(F.size("_hit") > 0, False) & F.col("pct").isNotNull()
    out = F.when(hit, F.get("_hit", F.lit(0))).otherwise(F.element_at("_p", horizon))
    d = d.withColumn("_x", out).withColumn("triggered", hit)
    return d.select("code", "entry_dt", "stop", "triggered", F.col("_x.k").alias("hold_days"), ((F.col("_x.close") / F.col("entry_close") - 1) * 100).alias("ret"))


def stop_study(exits: DataFrame) -> DataFrame:
    agg = exits.groupBy("stop").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("avg_return"), share(F.col("ret") > 0).alias("win_rate"), share(F.col("ret") > 10).alias("win_gt10"),
        F.min("ret").alias("max_loss"), F.stddev_pop("ret").alias("std_return"), F.avg("hold_days").alias("avg_hold_days"), share(F.col("triggered")).alias("trigger_rate"),
    )
    return agg.join(exact_percentiles(exits, ["stop"], "ret", {"median_return": 0.5}), "stop")


# Fixed trading costs: buying, selling, stamp duty.
BUY_COST, SELL_COST, STAMP = 0.00025, 0.00025, 0.0005


def trade_ledger(entries: DataFrame, scored: DataFrame, rank_stop: float = 50.0, hard_stop: float = -8.0, max_hold: int = 20) -> DataFrame:
    """Exit of every entry: first of rank worse than the limit, loss beyond the hard stop, longest hold.

    entries: (code, dt); scored: (code, dt, close, rank_pct). Trades are independent of each other.
    """
    path = forward_bars(entries, scored, max_hold).join(scored.select("code", "dt", "rank_pct"), ["code", "dt"])
    loss = (F.col("close") / F.col("entry_close") - 1) * 100
    reason = F.when(F.col("rank_pct") > rank_stop, "rank").when(loss <= hard_stop, "stop").when(F.col("k") >= max_hold, "time")
    ev = path.withColumn("reason", reason)
    hits = ev.groupBy("code", "entry_dt").agg(
        F.min_by(F.struct("k", "dt", "close", "reason"), F.when(F.col("reason").isNotNull(), F.col("k"))).alias("_x"),
        F.first("entry_close").alias("entry_close"), F.max(F.when(F.col("reason").isNotNull(), 1)).alias("_any"),
    )
    done = hits.where("_any = 1").select("code", "entry_dt", "entry_close", F.col("_x.dt").alias("exit_dt"), F.col("_x.k").alias("hold_days"), F.col("_x.close").alias("exit_close"), F.col("_x.reason").alias("exit_reason"))
    held = ev.join(done.select("code", "entry_dt", "hold_days"), ["code", "entry_dt"]).where(F.col("k") <= F.col("hold_days")).groupBy("code", "entry_dt").agg(
        F.avg("rank_pct").alias("avg_rank"), (F.min(F.least(F.col("close") / F.col("entry_close") - 1, F.lit(0.0))) * 100).alias("worst_pct")
    )
    net = (F.col("exit_close") * (1 - SELL_COST - STAMP)) / (F.col("entry_close") * (1 + BUY_COST)) - 1
    return done.withColumn("ret", net * 100).join(held, ["code", "entry_dt"])


def holdings_diff(picks: DataFrame) -> DataFrame:
    """Opened, closed and held codes of every pick date against the previous one."""
    held = picks.select("dt", "code").distinct()
    dates = held.select("dt").distinct().withColumn("prev_dt", F.lag("dt").over(Window.orderBy("dt")))
    nxt = dates.select(F.col("prev_dt").alias("dt"), F.col("dt").alias("now_dt")).where("dt is not null")
    before = held.join(nxt, "dt").select(F.col("now_dt").alias("dt"), "code", F.lit(1).alias("_b"))
    d = held.withColumn("_n", F.lit(1)).join(before, ["dt", "code"], "full")
    state = F.when(F.col("_n").isNull(), "closed").when(F.col("_b").isNull(), "opened").otherwise("held")
    return d.select("dt", "code", state.alias("state"))


def portfolio_nav(picks: DataFrame, ret: str = "t1_ret") -> DataFrame:
    """Equal-weight value of the picks, one row per date (next-day returns in percent)."""
    daily = picks.groupBy("dt").agg(nz(F.avg(ret) / 100).alias("ret"), F.count(F.lit(1)).alias("n_held"))
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("log_nav", F.sum(F.log1p("ret")).over(w))
    return d.withColumn("log_drawdown", F.col("log_nav") - F.greatest(F.max("log_nav").over(w), F.lit(0.0)))



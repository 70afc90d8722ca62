"""Gap risk, decay cuts and the routing of candidates into portfolios, for all dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import with_pct_rank, with_place
from ..functions.scalar import clip, div0, nz, one_if, rd
from ..functions.windows import lead
from .predicates import combined

# Allocation per market state.
ALLOCATION = {
    "bull": {"top_n": 5, "weights": {"p_momentum": 0.60, "p_reversion": 0.20, "p_breakout": 0.20}, "max_position": 1.00, "gate": "p_momentum"},
    "range": {"top_n": 3, "weights": {"p_momentum": 0.0, "p_reversion": 0.70, "p_breakout": 0.0}, "max_position": 0.50, "gate": "p_reversion"},
    "bear": {"top_n": 3, "weights": {"p_momentum": 0.0, "p_reversion": 0.0, "p_breakout": 0.0}, "max_position": 0.20, "gate": "p_reversion"},
}
GAP_LIMIT, GAP_PENALTY = 0.40, -15.0


def gap_risk(panel: DataFrame, n: int = 60, big_up: float = 5.0, gap_down: float = -1.0, min_rows: int = 20) -> DataFrame:
    """Share of big-up days followed by a gap down, over the last n bars of each code."""
    newest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))
    d = panel.select("code", "dt", "pct_chg", lead(F.col("open") / F.col("pre_close") - 1).alias("_g"), newest.alias("_k")).where(F.col("_k") <= n)
    big = F.col("pct_chg") >= big_up
    agg = d.groupBy("code").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(one_if(big)).alias("_b"),
        F.sum(one_if(big & (nz("_g") * 100 <= gap_down))).alias("_h"), F.min("dt").alias("window_start"), F.max("dt").alias("window_end"),
    )
    ok = F.col("_n") >= min_rows
    return agg.select(
        "code",
        F.when(ok & (F.col("_b") > 0), rd(div0("_h", "_b"))).otherwise(0.0).alias("score"),
        F.when(ok, F.col("_b")).otherwise(0).alias("big_up_days"),
        F.when(ok, F.col("_h")).otherwise(0).alias("gap_down_after"),
        "window_start", "window_end", (~ok).alias("insufficient"),
    )


def gap_risk_panel(panel: DataFrame, n: int = 60, big_up: float = 5.0, gap_down: float = -1.0, min_rows: int = 20, kept: Sequence[str] = ()) -> DataFrame:
    """The same risk as of every bar: the follow-up of the newest bar is not known yet. ``kept`` columns of the panel go along."""
    from ..functions.windows import lag, last_n

    big = F.col("pct_chg") >= big_up
    d = panel.select("code", "dt", *kept, one_if(big).alias("_b"), one_if(lag(one_if(big)).eqNullSafe(1) & ((F.col("open") / F.col("pre_close") - 1) * 100 <= gap_down)).alias("_h"))
    w, inner = last_n(n), last_n(n - 1)
    ok = F.count(F.lit(1)).over(w) >= min_rows
    hits = F.sum("_h").over(inner)
    return d.select("code", "dt", *kept, F.when(ok, nz(rd(div0(hits, F.sum("_b").over(w))))).otherwise(0.0).alias("t1_lock_risk"))


def with_gap_penalty(scored: DataFrame, risk: DataFrame, score: str, limit: float = GAP_LIMIT, penalty: float = GAP_PENALTY, eliminate: bool = False) -> DataFrame:
    d = scored.join(risk.select("code", F.col("score").alias("t1_lock_risk")), "code", "left").withColumn("t1_lock_risk", nz("t1_lock_risk"))
    d = d.withColumn("t1_high_risk", F.col("t1_lock_risk") > limit)
    if eliminate:
        return d.where(~F.col("t1_high_risk"))
    return d.withColumn(score, F.when(F.col("t1_high_risk"), F.col(score) + penalty).otherwise(F.col(score)))


def defensive_scores(df: DataFrame, by: list[str], vol: str = "atr_pct", value: tuple[str, ...] = ("value_score",)) -> DataFrame:
    """Low volatility ranks high, tilted by half a rank of each value column."""
    d = with_pct_rank(df, by, vol, "_r0", scale=1.0)
    total = -nz("_r0")
    for i, v in enumerate(value):
        d = with_pct_rank(d, by, v, f"_v{i}", scale=1.0)
        total = total + nz(f"_v{i}") * 0.5
    return d.withColumn("defensive_score", total).drop("_r0", *[f"_v{i}" for i in range(len(value))])


def rows_above(df: DataFrame, by: list[str], score: str, tie: str = "code", out: str = "place", total: str | None = None) -> DataFrame:
    """Unique descending place of every row inside its group, ties by code, without one task per group or score;
    rows without a score have none. ``total``: the rows of the group."""
    x = F.col(score).cast("double")
    missing = x.isNull() | F.isnan(x)
    d = with_place(df, by, [missing, F.when(~missing, -x), F.col(tie)], out, total)
    return d.withColumn(out, F.when(~missing, F.col(out)))


def defensive_filter(df: DataFrame, by: list[str], keep: float = 0.40, floor: int = 10, **kw) -> DataFrame:
    """Best ``keep`` share by defensive score, at least ``floor`` rows per group."""
    d = rows_above(defensive_scores(df, by, **kw), by, "defensive_score", total="_n")
    n_keep = F.greatest(F.floor(F.col("_n") * keep), F.least(F.lit(floor), F.col("_n")))
    return d.where(F.col("place") <= n_keep).drop("_n", "place")


def defense_pool(valuation: DataFrame, bars: DataFrame, asof: Column | None = None, pe: tuple[float, float] = (0.0, 15.0), pb_max: float = 2.0, atr_max: float = 2.0, limit: int | None = None) -> DataFrame:
    """Cheap and calm instruments: newest PE/PB in range, mean true range of 20 bars below atr_max percent; the ``limit`` calmest,
    or all if None."""
    from .indicators import true_range
    from .snapshots import latest_rows
    from ..functions.windows import last_n

    cheap = latest_rows(valuation.where("pe_ttm is not null and pb is not null"), asof=asof).where(F.col("pe_ttm").between(*pe) & (F.col("pb") < pb_max))
    d = bars.where(F.col("dt") <= asof) if asof is not None else bars
    d = d.join(cheap.select("code"), "code", "left_semi")
    # 21 bars per code, the first one only gives the previous close
    d = d.select("code", "dt", "close", (F.col("high") - F.col("low")).alias("_hl"), true_range(False).alias("_tr"))
    d = d.select("*", F.count(F.lit(1)).over(last_n(21)).alias("_n"), F.avg("_tr").over(last_n(20)).alias("_a"), F.avg(F.coalesce("_tr", "_hl")).over(last_n(21)).alias("_b"))
    newest = latest_rows(d, min_rows=11).withColumn("atr_pct", rd(F.col("_a") / F.col("close") * 100, 3))
    calm = newest.where(F.col("atr_pct") < atr_max).select("code", "atr_pct")
    return calm if limit is None else calm.orderBy("atr_pct", "code").limit(limit)


def composite_scores(df: DataFrame, gate: float = 0.55) -> DataFrame:
    """Score of every candidate under its date's state: weighted engines times the soft gate."""
    score, mult, top = None, None, None
    for state, a in ALLOCATION.items():
        here = F.col("state") == state
        m = rd(clip(F.col(a["gate"]) / gate, 0.3, 1.2))
        if any(w > 0 for w in a["weights"].values()):
            s = rd(combined(a["weights"]) * m)
        else:
            s = rd(F.col(a["gate"]) * clip(F.col(a["gate"]) / gate, 0.3, 1.2)) * 0.5 + F.col("defensive_score") * 0.5
        score = F.when(here, s) if score is None else score.when(here, s)
        mult = F.when(here, m) if mult is None else mult.when(here, m)
        top = F.when(here, F.lit(a["top_n"])) if top is None else top.when(here, F.lit(a["top_n"]))
    return df.select("*", mult.alias("soft_multiplier"), score.alias("composite_score"), top.alias("top_n"))


def route(candidates: DataFrame, gate: float = 0.55) -> DataFrame:
    """Portfolio per date: bear dates keep the defensive share, then gap penalty, decay cut,
    momentum and volume boosts, best N, and one seat for the defence pool on bear dates.

    ``candidates``: dt, code, state, engine probabilities, atr_pct, value_score, mom5, spike,
    t1_lock_risk, alpha_decay_cut, in_pool.
    """
    from ..session import materialised
    from .cross import top_share_boost
    from .predicates import volume_adjust

    # the ranks below read their input several times: materialise it at two points
    candidates = materialised(candidates)
    bear = defensive_filter(candidates.where("state = 'bear'"), ["dt"])
    rest = candidates.where("state <> 'bear'").withColumn("defensive_score", F.lit(None).cast("double"))
    d = materialised(composite_scores(rest.unionByName(bear), gate))
    d = d.withColumn("t1_high_risk", F.col("t1_lock_risk") > GAP_LIMIT).withColumn(
        "composite_score", F.when(F.col("t1_high_risk"), F.col("composite_score") + GAP_PENALTY).otherwise(F.col("composite_score"))
    )
    d = d.where(~F.col("alpha_decay_cut"))
    d = top_share_boost(d, ["dt"], "mom5")
    adj = volume_adjust("composite_score", "spike")
    d = d.select(*[x for x in d.columns if x != "composite_score"], adj["vol_boost"].alias("vol_boost"), adj["score_out"].alias("composite_score"))
    d = materialised(d)
    best = Window.partitionBy("dt").orderBy(F.desc("composite_score"), "code")
    top = d.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(a["top_n"] for a in ALLOCATION.values())).where(F.col("place") <= F.col("top_n"))
    # bear dates without a pool member: the pool's best candidate takes the last seat
    has = top.groupBy("dt").agg(F.max(one_if(F.col("in_pool"))).alias("_has"), F.max("place").alias("_last"))
    pool = d.where("in_pool and state = 'bear'").withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    seat = pool.join(has.where("_has = 0"), "dt").withColumn("place", F.col("_last")).drop("_has", "_last")
    freed = seat.select("dt", "place")
    return top.join(freed, ["dt", "place"], "left_anti").unionByName(seat.select(*top.columns))

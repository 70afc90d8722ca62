"""Row-level rules: labels, boards, gates, status and bonus formulas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import c, clip, div0, flag, nz, present, rd, tiers

MIN_PRICE = 3.0
WINRATE_GATE = 0.55


def board_type(code) -> Column:
    """Exchange board by code prefix, 0 when none fits."""
    s = c(code).cast("string")
    return tiers(
        [(s.startswith("60"), 1.0), (s.startswith("00"), 2.0), (s.startswith("30"), 3.0), (s.startswith("68"), 4.0),
         (s.startswith("4") | s.startswith("8"), 5.0)],
        0.0,
    )


def wide_limit(code) -> Column:
    """Boards with the 20% daily limit."""
    s = c(code).cast("string")
    return s.startswith("30") | s.startswith("68")


def tradable(day: DataFrame, min_price: float = MIN_PRICE) -> DataFrame:
    return day.where((F.col("close") >= min_price) & (F.col("vol") > 0) & F.col("mom5").isNotNull())


def without_keywords(df: DataFrame, name: str, words: Sequence[str]) -> DataFrame:
    """Rows whose name holds none of the words (a missing name passes)."""
    if not words:
        return df
    return df.where(~nz(F.col(name).rlike("|".join(re.escape(w) for w in words)), False))


def overbought_warnings(ma20_dev, mom5, volume_ratio, atr_pct) -> Column:
    ma, mo, vr, at = c(ma20_dev), c(mom5), c(volume_ratio), c(atr_pct)
    return present(
        F.when(ma > 50, "severe_overbought").when(ma > 30, "overbought"),
        F.when(mo > 50, "short_term_spike"), F.when(vr < 0.3, "severe_shrink"), F.when(at > 10, "extreme_range"),
    )


def market_status(close, support, resistance, breakout, volume_ratio, surge: float = 1.2, buffer: float = 0.005) -> dict[str, Column]:
    """Breakout / unconfirmed / breakdown / range / unclear, with action and confidence."""
    px, sp, rs, br, vr = c(close), c(support), c(resistance), c(breakout), c(volume_ratio)
    up, down = px > br, px < sp * (1 - buffer)
    inside = (px >= sp) & (px <= rs)
    pick = [(up & (vr >= surge), 0), (up, 1), (down, 2), (inside, 3)]
    state = tiers(list(zip([p for p, _ in pick], ["breakout", "breakout_unconfirmed", "breakdown", "range"])), "unclear")
    action = tiers(list(zip([p for p, _ in pick], ["add", "watch", "reduce", "hold"])), "hold")
    conf = tiers(
        [
            (up & (vr >= surge) & (vr >= 1.5), "high"), (up & (vr >= surge), "medium"), (up, "low"),
            (down & (vr >= 1.0), "high"), (down, "medium"), (inside, "medium"),
        ],
        "low",
    )
    return {"status": state, "action": action, "confidence": conf}


def level_probability(price, level, upper, lower, mid, direction: str = "down") -> Column:
    """Chance class (0 lowest .. 4 highest) of reaching a level, from its distance in band widths; -1 unknown, 5 touched."""
    px, lv = c(price), c(level)
    unit = div0(c(upper) - c(lower), c(mid) * 4)
    beyond = px > lv if direction == "down" else px < lv
    n = div0(F.abs(px - lv) / px, unit)
    return tiers(
        [
            (unit.isNull() | (unit <= 0) | lv.isNull() | px.isNull(), -1), (~beyond, 5),
            (n < 0.5, 4), (n < 1.0, 3), (n < 2.0, 2), (n < 3.5, 1),
        ],
        0,
    )


def dso(ar_turn) -> Column:
    """Days of sales outstanding; NULL for a non-positive turnover, 0 beyond 5000."""
    t = c(ar_turn)
    return F.when(t > 5000, 0.0).when(t > 0, div0(F.lit(365.0), t))


def winrate_gate(p, threshold: float = WINRATE_GATE) -> Column:
    return F.when(c(p) >= threshold, "pass").otherwise("veto")


def volume_bonus(score, spike, lo: float = 5.0, hi: float = 8.0) -> dict[str, Column]:
    """Absolute bonus growing from spike 1.5 to 3.0, and the shrink factor 1.1 below 0.7."""
    s = nz(spike, 1.0)
    bonus = F.when(s > 1.5, rd(clip((s - 1.5) / 1.5, 0, 1) * (hi - lo) + lo, 2)).otherwise(0.0)
    boost = F.when(s < 0.7, 1.1).otherwise(1.0)
    return {"vol_shock_bonus": bonus, "vol_shock_conf_boost": boost, "score_out": (c(score) + bonus) * boost}


def volume_adjust(score, spike, lo: float = 0.05, hi: float = 0.08) -> dict[str, Column]:
    """Bonus on the 0-1 scale, rounded after each step as the composite score is."""
    s = nz(spike, 1.0)
    bonus = F.when(s > 1.5, clip(div0(s - 1.5, s), 0, 1) * (hi - lo) + lo).otherwise(0.0)
    out = rd(rd(c(score) + bonus) * F.when(s < 0.7, 1.1).otherwise(1.0))
    return {"vol_boost": tiers([(s > 1.5, "breakout"), (s < 0.7, "shrink")], ""), "score_out": out}


def engine_volume_adjust(spike, price_position, ma20_dev, lo: float = 0.05, hi: float = 0.08, pos_min: float = 0.7, dev_max: float = 0.0) -> dict[str, Column]:
    """Engine probabilities lifted where volume confirms: breakouts on swelling, reversions on shrinking volume."""
    s = nz(spike, 1.0)
    swell = clip(div0(s - 1.5, s), 0, 1) * (hi - lo) + lo
    shrink = clip((F.lit(0.7) - s) / 0.7, 0, 1) * (hi - lo) + lo
    mom = (s > 1.5) & (nz(price_position, 1.0) >= pos_min)
    brk = s > 1.5
    rev = (s < 0.7) & (nz(ma20_dev, -1.0) < dev_max)
    return {
        "p_momentum": clip(F.col("p_momentum") + F.when(mom, swell).otherwise(0.0), 0, 1),
        "p_breakout": clip(F.col("p_breakout") + F.when(brk, swell).otherwise(0.0), 0, 1),
        "p_reversion": clip(F.col("p_reversion") + F.when(rev, shrink).otherwise(0.0), 0, 1),
        "vol_momentum_confirmed": flag(mom), "vol_breakout_confirmed": flag(brk), "vol_reversion_confirmed": flag(rev),
    }


def alpha_decay(p_init, p_today, ratio: float = 0.75) -> dict[str, Column]:
    """Cut when today's probability is below ``ratio`` of the entry's; a missing one counts as 0."""
    a, b = nz(p_init), nz(p_today)
    threshold = rd(a * ratio)
    return {"threshold": threshold, "decay": F.when(a > 0, rd(div0(b, a))).otherwise(1.0), "alpha_decay_cut": b < threshold}


def soft_weight(probs: Sequence[str], target: float = 0.55, lo: float = 0.3, hi: float = 1.2) -> dict[str, Column]:
    """Mean probability and its multiplier clip(p / target)."""
    mean = sum((F.col(p) for p in probs[1:]), F.col(probs[0])) / len(probs)
    mult = clip(mean / target, lo, hi)
    return {"soft_multiplier": rd(mult), "composite_score": rd(mean * mult)}


def combined(weights: dict[str, float]) -> Column:
    """Probabilities combined by weights rescaled to one over the positive ones."""
    used = {p: w for p, w in weights.items() if w > 0}
    total = sum(used.values())
    return sum((F.col(p) * (w / total) for p, w in used.items()), F.lit(0.0))

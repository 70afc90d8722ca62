"""Joins between panels: dimension, parent, as-of, band, range and nearest-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_join
from ..functions.ranks import with_bucket, with_position
from ..functions.scalar import nz, one_if
from ..functions.windows import momentum
from .snapshots import latest_rows


def with_dimension(df: DataFrame, dim: DataFrame, names: Sequence[str], key: str = "code", unknown: str = "UNKNOWN") -> DataFrame:
    """Left join of a dimension; missing names read ``unknown``."""
    d = df.join(dim.select(key, *names), key, "left")
    return d.withColumns({n: F.coalesce(n, F.lit(unknown)) for n in names})


def excess_over_parent(bars: DataFrame, parents: DataFrame, parent_bars: DataFrame, n: int = 20) -> DataFrame:
    """Newest n-bar return of each instrument minus that of its parent."""
    own = latest_rows(bars.withColumn("own_ret", momentum(n)), min_rows=n + 1).select("code", "own_ret")
    par = latest_rows(parent_bars.withColumn("ind_ret", momentum(n)), min_rows=n + 1).select(F.col("code").alias("parent"), "ind_ret")
    return own.join(parents, "code").join(par, "parent").withColumn("excess", F.col("own_ret") - F.col("ind_ret"))


def asof_returns(bars: DataFrame, industry_returns: DataFrame, parents: DataFrame) -> DataFrame:
    """Industry return at or before each bar's date (industry gaps are bridged)."""
    left = bars.join(parents, "code").select("code", "dt", "parent")
    right = industry_returns.select(F.col("code").alias("parent"), "dt", "ind_ret").where("ind_ret is not null")
    days = left.select("parent", "dt").distinct()
    matched = asof_join(days, right, "parent", "dt", ["ind_ret"])
    return left.join(matched, ["parent", "dt"], "left")


def latest_asof(panel: DataFrame, values: Sequence[str], asof: Column) -> DataFrame:
    """Newest row per code not later than ``asof``, rows with a missing value skipped."""
    ok = panel.where(" and ".join(f"{v} is not null" for v in values))
    return latest_rows(ok, asof=asof).select("code", "dt", *values)


def external_panels(bars: DataFrame, panels: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins on (code, dt); every right side is made unique on the key first."""
    for panel, cols in panels:
        bars = bars.join(panel.select("code", "dt", *cols).dropDuplicates(["code", "dt"]), ["code", "dt"], "left")
    return bars


def inner_all(panels: Sequence[DataFrame], keys: Sequence[str] = ("dt", "code")) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.join(p, list(keys))
    return out


def trades_in_folds(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """Trades with val_start <= date <= val_end: folds become dates, the join an equi join."""
    days = folds.select("fold", F.explode(F.sequence("val_start", "val_end")).alias("dt"))
    return trades.join(days, "dt")


def days_before_events(events: DataFrame, calendar: DataFrame, k: int) -> DataFrame:
    """(event_dt, dt, offset) for the 1..k trading days before each event date."""
    e = events.select(F.col("dt").alias("event_dt")).distinct().join(
        calendar.select(F.col("dt").alias("event_dt"), "date_idx"), "event_dt"
    )
    back = e.select("event_dt", "date_idx", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("offset"))
    back = back.withColumn("date_idx", F.col("date_idx") - F.col("offset"))
    return back.join(calendar.select("date_idx", "dt"), "date_idx").select("event_dt", "dt", "offset")


def forward_bars(picks: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Bars 1..horizon after each pick's entry bar (own bars), joined on the bar index."""
    w = Window.partitionBy("code").orderBy("dt")
    idx = bars.select("code", "dt", "close", F.row_number().over(w).alias("_i"))
    entry = picks.select("code", F.col("dt").alias("entry_dt")).join(
        idx.select("code", F.col("dt").alias("entry_dt"), F.col("close").alias("entry_close"), F.col("_i").alias("_e")), ["code", "entry_dt"]
    )
    steps = entry.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k")).withColumn("_i", F.col("_e") + F.col("k"))
    return steps.join(idx, ["code", "_i"]).select("code", "entry_dt", "entry_close", "k", "dt", "close")


def common_codes(a: DataFrame, b: DataFrame, key: str = "code") -> DataFrame:
    return a.join(b, key, "left_semi")


def without_codes(a: DataFrame, held: DataFrame, key: str = "code") -> DataFrame:
    return a.join(held, key, "left_anti")


def nearest_by_score(candidates: DataFrame, history: DataFrame, n: int = 80, min_rows: int = 10) -> DataFrame:
    """Outcome statistics of the n history rows nearest in score to each candidate.

    The n nearest neighbours lie within n positions on either side of the candidate's
    place in the score order, so positions are joined instead of every pair:
    candidates(cand_id, score), history(hist_id, score, outcome).
    """
    h = with_position(history.where("score is not null"), "score", "hist_id", "pos").select(
        F.col("score").alias("hs"), "outcome", "pos"
    )
    # place = number of history rows with a lower score, read from the merged order
    merged = candidates.select("cand_id", "score", F.lit(0).alias("_h")).unionByName(
        history.where("score is not null").select(F.lit(None).cast("long").alias("cand_id"), "score", F.lit(1).alias("_h"))
    )
    per_score = merged.groupBy("score").agg(F.sum("_h").alias("_n"))
    per_score = with_bucket(per_score, [], [F.col("score")])
    tot = per_score.groupBy("_b").agg(F.sum("_n").alias("_t"))
    run = F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    below = F.sum("_n").over(Window.partitionBy("_b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    place = per_score.withColumn("_w", below).join(tot.withColumn("_o", run), "_b").select("score", (F.col("_w") + F.col("_o")).alias("place"))
    c = candidates.join(place, "score")
    near = c.select("cand_id", "score", "place", F.explode(F.sequence(F.col("place") - (n - 1), F.col("place") + n)).alias("pos"))
    pairs = near.join(h, "pos").withColumn("_d", F.abs(F.col("hs") - F.col("score")))
    rk = F.row_number().over(Window.partitionBy("cand_id").orderBy("_d", F.abs(F.col("pos") - F.col("place") - 0.5), "pos"))
    return (
        pairs.withColumn("_k", rk)
        .where(F.col("_k") <= n)
        .groupBy("cand_id")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.avg("outcome").alias("mean_outcome"),
            (F.avg(one_if(F.col("outcome") > 0)) * 100).alias("win_rate"),
            F.max("_d").alias("max_distance"),
        )
        .where(F.col("n_near") >= min_rows)
    )

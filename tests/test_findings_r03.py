"""Steps of the findings of round 3 that moved or rebuilt whole panels."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import forward, load
from tidemark.operators import indicators as ind
from tidemark.operators import picks as pk
from tidemark.plans import backtests as bt

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def panel(spark):
    d = spark.range(60).select(F.lit(1).alias("code"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("dt"), (F.col("id") + 100.0).alias("close"))
    return d.select("*", F.col("close").alias("high"), F.col("close").alias("low"), F.lit(5.0).alias("vol"))


def test_stop_exits_take_paths_in_the_bars_own_pass(spark):
    """One join of the few picks, instead of the bars joined twice by other keys and the picks again."""
    bars = panel(spark)
    out = bt.stop_exits(bars.where("dt in (date'2020-01-10', date'2020-02-27')").select("code", "dt", F.lit(2.0).alias("atr_ratio")), bars)
    assert plan(out).count("Join ") == 1
    assert {(str(r.entry_dt), r.hold_days) for r in out.collect()} == {("2020-01-10", 5)}  # the later pick lacks a full horizon


def test_day_scores_join_stored_means(spark):
    assert "Aggregate" not in plan(pk.day_scores(pk.day_factors(panel(spark))))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_engine_probabilities_do_not_build_bars_where_they_join(spark):
    d = load().queries["engine_probabilities"](spark, SMALL)
    assert "Aggregate" not in plan(d) and plan(d).count("Join ") == 2


def test_return_statistics_evaluate_each_window_once(spark):
    """Eleven aggregates over 20 bars, however often the statistics name them."""
    bars = ind.daily_return(panel(spark))
    out = ind.return_stats(bars)
    assert plan(out).count("specifiedwindowframe(RowFrame, -19") <= 11
    assert out.columns[: len(bars.columns)] == bars.columns and not any(c.startswith("_") for c in out.columns)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_sector_features_build_bars_once(spark):
    """Bars and industry means, no second build of the bars for the RSI."""
    assert plan(forward.sector_features(spark, SMALL)).count("Aggregate") == 2

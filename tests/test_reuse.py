"""Stages that are read many times are built once, and windows sort narrow rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import extras, load
from tidemark.plans import features as fm

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_group_regressors_read_stored_rows(spark, monkeypatch):
    load()
    built, seen = [], {}
    bars = extras.src.instrument_bars
    monkeypatch.setattr(extras.src, "instrument_bars", lambda *a: built.append(1) or bars(*a))
    monkeypatch.setattr(extras.md, "fit_group_regressors", lambda d, groups, columns, **kw: seen.update(d=d, groups=groups) or {})
    monkeypatch.setattr(extras.md, "rerank", lambda picks, newest, models, groups: newest.withColumns({"ml_pred": F.lit(0.0), "ml_score": F.lit(0.0)}))
    extras.size_group_rerank(spark, SMALL)
    assert len(built) == 1
    assert all("Window" not in t._jdf.queryExecution().optimizedPlan().toString() for t in seen.values())
    assert seen["groups"].count() == seen["d"].select("code").distinct().count()


def test_derived_features_are_a_narrow_table(spark):
    reads = {"atr_pct", "downside_vol", "bb_pct_b", "bb_width", "vwap_deviation", "lt_count_l1", "dt_count_l1", "lt_rate_l1", "rank_l1_in_all", "vol_ratio", "mom3", "mom20"}
    reads |= {k for pair in fm.PRODUCTS.values() for k in pair}
    d = spark.range(3).select(F.lit(1).alias("code"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("dt"), *[F.col("id").cast("double").alias(k) for k in (*sorted(reads), "unread")])
    out = fm.derived(d)
    assert "unread" not in out.columns and not reads & set(out.columns)
    assert out.orderBy("dt").collect()[2]["rsi_x_mom20"] == 4.0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["percentile_panel", "quantile_buckets", "rank_ic", "rank_ic_plain", "cross_section_ranks", "nearest_by_score", "weekly_rank_ic", "weekly_refit"])
def test_ranks_read_stored_rows(spark, name):
    assert "l_suppkey" not in _plan(load().queries[name](spark, SMALL))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_candidates_build_the_bars_once(spark):
    from tidemark.catalog import portfolios, rules, studies

    load()
    # the bars of the instruments and, for the state of the market, those of the regions
    assert _plan(portfolios.candidates(spark, SMALL)).count("Relation [l_orderkey") == 2
    for build in (rules.score_feats, studies.scored_feats, extras.labelled):
        plan = _plan(build(spark, SMALL))
        assert plan.count("Relation [l_orderkey") == 1 and "Join" not in plan


def test_splitters_are_chosen_before_they_are_grouped(spark):
    from tidemark.functions.ranks import tie_table, with_bucket

    d = spark.range(50).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    assert not with_bucket(d, ["g"], [F.col("x")]).schema["_b"].nullable
    plan = with_bucket(d, ["g"], [F.col("x")])._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("collect_set"):]
    assert "Filter" in below and "xxhash64" in below
    assert {r.n_group for r in tie_table(d.where("g < 2"), ["g"], "x").collect()} == {17}

"""Steps of the findings of round 4 that moved rows more often than they need."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranks import with_pct_ranks
from tidemark.plans import features as fm
from tidemark.sources.bars import with_change


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def ranked(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": ["hot"] * 300 + ["a"] * 50 + ["b"] * 3 + ["c"] * 2, "id": range(355)})
    pdf["x"] = np.where(rng.random(355) < 0.4, 0.0, np.round(rng.normal(0, 5, 355), 1))
    pdf["y"] = np.where(rng.random(355) < 0.2, np.nan, np.round(rng.normal(0, 1, 355), 2))
    pdf.loc[0:20:2, "x"] = -0.0
    pdf.loc[350:352, "x"] = 2.5
    pdf.loc[353:, "x"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    want = pd.DataFrame({k: pdf.groupby("g")[k].rank(pct=True) * 100 for k in "xy"})
    want.loc[pdf.groupby("g")["x"].transform("nunique") == 1, "x"] = 7.0
    return d, want


@pytest.mark.parametrize("group_rows", [1000, 100, 1])  # all groups whole, one cut, all cut
def test_groups_rank_alike_whole_and_cut(spark, group_rows):
    d, want = ranked(spark)
    got = with_pct_ranks(d, ["g"], ["g", "id"], {"rx": "x", "again": "x", "y": "y"}, constant=7.0, group_rows=group_rows)
    assert got.columns == ["g", "id", "x", "rx", "again", "y"]
    got = got.toPandas().sort_values("id")
    for o, s in {"rx": "x", "again": "x", "y": "y"}.items():
        np.testing.assert_allclose(got[o].to_numpy(dtype=float), want[s])


def test_ranks_of_small_groups_move_rows_once(spark):
    """Not stacked a row a ranked column, counted, joined back by value, gathered by key and joined."""
    d, _ = ranked(spark)
    p = executed(with_pct_ranks(d, ["g"], ["g", "id"], {"rx": "x", "ry": "y"}))
    assert p.count("Exchange") == 1 and "Join" not in p and "Generate" not in p


def test_matrix_rows_do_not_move_for_industries_and_dates(spark, make_bars):
    """The sides have a row a date or industry and date; stored, they are known to be small and are broadcast."""
    closes = {f"60000{k}": [10 + k + (i * (k + 3)) % 7 for i in range(30)] for k in range(4)}
    members = spark.createDataFrame([(f"60000{k}", f"a{k // 2}", f"b{k}") for k in range(4)], "code string, l1 string, l2 string")
    panel = with_change(make_bars(closes))
    x = fm.Inputs(bars=panel, members=members, l1=make_bars({"a0": range(20, 50), "a1": range(50, 20, -1)}), l2=panel)
    lying = fm.materialised(panel.join(members, "code"))
    out = fm.day_stage(lying, panel, x)
    plan = executed(out)
    assert "ShuffleQueryStage" not in plan and "SortMergeJoin" not in plan
    assert out.count() == 120 and out.where("advance_decline_ratio is null or up_pct_l1 is null").count() == 0


def test_first_block_has_the_industries(spark, make_bars, monkeypatch):
    """Members are joined where the rows lie by code."""
    stored = []
    monkeypatch.setattr(fm, "materialised", lambda df: stored.append(df) or df)
    bars = with_change(make_bars({"600001": range(10, 40)}))
    members = spark.createDataFrame([("600001", "a", "b")], "code string, l1 string, l2 string")
    _, trend = fm.window_stage(bars, members)
    assert stored[0] is trend and {"l1", "l2", "mom20"} <= set(trend.columns)
    assert trend.select("l1", "l2").distinct().collect() == [("a", "b")]

"""Hierarchies of any depth, adjusted smoothing and the threshold study's zones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ewm import with_ewm_adjusted
from tidemark.operators import indicators as ind, industry as ops

RNG = np.random.default_rng(4)


def test_closure_and_levels(spark, make_bars):
    parents = spark.createDataFrame([("c1", "b1"), ("c2", "b1"), ("b1", "a1"), ("b2", "a1"), ("a1", None)], "child string, parent string")
    leaves = spark.createDataFrame([("x", "c1"), ("y", "b2"), ("z", None)], "code string, parent string")
    tree = ops.closure(parents, leaves)
    assert sorted(map(tuple, tree.collect())) == [("x", 1, "c1"), ("x", 2, "b1"), ("x", 3, "a1"), ("y", 1, "b2"), ("y", 2, "a1")]
    groups = {g: [100.0] * 20 + [100 + k] for g, k in {"a1": 1.0, "b1": 3.0, "c1": -2.0}.items()}  # b2 has no bars
    day = dt.date(2020, 1, 21)
    features = spark.createDataFrame([("x", day, 5.0), ("y", day, 0.0), ("z", day, 7.0)], "code string, dt date, mom20 double")
    market = make_bars({"m": [100.0] * 20 + [104.0]})
    got = {(r.code, r.level): (r.group, r.excess_return, r.divergence, r.agreeing) for r in ops.hierarchy_levels(features, tree, make_bars(groups), market).collect()}
    near = lambda *v: tuple(x if x is None or isinstance(x, str) else pytest.approx(x) for x in v)
    assert got == {
        ("x", 1): near("a1", 4.0, None, 2), ("x", 2): near("b1", 2.0, 2.0, 2), ("x", 3): near("c1", 7.0, -5.0, 2),
        ("y", 1): near("a1", -1.0, None, 0), ("y", 2): near("b2", 0.0, -1.0, 0), ("z", 0): near(None, 3.0, None, 1),
    }


def test_closure_rejects_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        ops.closure(parents, spark.createDataFrame([("x", "a")], "code string, parent string"), deepest=4)


def test_adjusted_smoothing_is_pandas(spark):
    values = [None, 3.0, None, *[None if RNG.random() < 0.1 else float(RNG.normal()) for _ in range(700)]]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 2.0), ("c", 0, None)], "code string, dt int, x double")
    specs = {"y3": ("x", 0.5), "y26": ("x", 2 / 27), "y1": ("x", 1.0)}
    got = with_ewm_adjusted(df, specs).where("code = 'a'").orderBy("dt").toPandas()
    x = pd.Series(values, dtype=float)
    for out, (_, a) in specs.items():
        np.testing.assert_allclose(got[out], x.ewm(alpha=a, adjust=True, ignore_na=True).mean(), rtol=1e-9, atol=1e-11)
    one = {r.code: r.y26 for r in with_ewm_adjusted(df, specs).where("code <> 'a'").collect()}
    assert one == {"b": pytest.approx(2.0), "c": None}


def test_study_zones_match_a_walk(spark, make_bars):
    closes = np.round(np.exp(np.cumsum(RNG.normal(0, 0.03, 200))) * 50, 2).tolist()
    vols = RNG.integers(50, 200, 200).astype(float).tolist()
    got = {r.n_bars: r for r in ops.study_zones(make_bars({"a": closes, "b": list(range(1, 121))}, {"a": vols, "b": [1.0] * 120})).where("code = 'a'").collect()}
    c, v = pd.Series(closes), pd.Series(vols)
    dif = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    d = c.diff()
    gain, loss = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
    rsi = 100 - 100 / (1 + gain / loss.replace(0, np.nan))
    ratio = v / v.rolling(20).mean()
    assert sorted(got) == list(range(60, 201))
    for n, r in got.items():
        i = n - 1
        peaks = [j for j in range(i - 54, i - 4) if closes[j] > max(closes[j - 5 : j]) and closes[j] > max(closes[j + 1 : j + 6])]
        diverges = len(peaks) >= 2 and closes[peaks[-1]] > closes[peaks[-2]] and dif[peaks[-1]] <= dif[peaks[-2]]
        if rsi[i] > 50 and dif[i] > 0:
            zone = "chase" if ratio[i] >= 0.8 else "watch"
        elif dif[i] > 0 or rsi[i] > 45:
            zone = "watch"
        else:
            zone = "top_warn" if rsi[i] < 30 else "weak"
        assert (r.zone, r.divergence, r.macd_dif) == (zone, diverges, pytest.approx(dif[i], abs=1e-9)), n


def test_rising_bars_have_no_rsi(make_bars):
    """Without a loss RSI is unknown: the positive DIF alone makes the zone."""
    rows = ops.study_zones(make_bars({"b": list(range(1, 121))})).collect()
    assert len(rows) == 61 and {r.zone for r in rows} == {"watch"} and all(r.rsi_14 is None for r in rows)
    assert ind.macd(make_bars({"b": [5.0] * 30}), adjusted=True).where(F.abs("macd_hist") > 1e-12).count() == 0

"""Weight grids against one weighting at a time."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import grids

RNG = np.random.default_rng(8)


def test_simplex():
    got = grids.simplex(3, 4)
    assert len(got) == 15 and all(sum(w) == pytest.approx(1) for w in got) and len(set(got)) == 15
    assert all(sum(x > 0 for x in w) >= 2 for w in grids.simplex(6, 5, 2)) and len(grids.simplex(6, 5, 2)) == 246
    assert grids.four_factor_weights([0.3], [0.25]) == [(0.3, 0.25, 0.2, 0.25)]


@pytest.fixture(scope="module")
def local():
    out = []
    for i in range(40):
        for code in range(9):
            a, b = round(float(RNG.random()), 1), None if RNG.random() < 0.05 else round(float(RNG.random()), 1)
            y = None if RNG.random() < 0.1 else float(RNG.normal())
            out.append((code, dt.date(2021, 1, 1) + dt.timedelta(days=i), a, b, y, [None, "up", "down"][i % 3]))
    return out


SCHEMA = "code long, dt date, a double, b double, y double, mood string"
WEIGHTS = [(1.0, 0.0), (0.5, 0.5), (0.2, 0.8)]


def average_ranks(values):
    return [sum(v > x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_separation(spark, local):
    got = {(r.regime, r.combo): r for r in grids.weight_separation(spark.createDataFrame(local, SCHEMA), ["a", "b"], WEIGHTS, "y", regime="mood", least=5).collect()}
    assert set(got) == {(m, k) for m in ("ALL", "up", "down") for k in range(3)}
    for (mood, k), r in got.items():
        top, low = [], []
        for day in {x[1] for x in local}:
            mine = [x for x in local if x[1] == day and x[4] is not None and x[3] is not None]
            if mood not in ("ALL", mine[0][5]):
                continue
            scores = [round(x[2] * WEIGHTS[k][0] + x[3] * WEIGHTS[k][1], 9) for x in mine]
            for x, rank in zip(mine, average_ranks(scores)):
                top += [x[4]] if rank / len(mine) <= 0.25 else []
                low += [x[4]] if rank / len(mine) >= 0.75 else []
        assert (r.n_top, r.n_bottom) == (len(top), len(low))
        assert r.separation == pytest.approx(np.mean(top) - np.mean(low)) and r.top_win == pytest.approx(np.mean(np.array(top) > 0) * 100)
    none = grids.weight_separation(spark.createDataFrame(local, SCHEMA), ["a", "b"], WEIGHTS, "y", least=10_000).collect()
    assert all(r.separation is None and r.n_top > 0 for r in none)


def test_portfolios(spark, local):
    d = spark.createDataFrame(local, SCHEMA).withColumn("next_ret", F.col("y") / 50)
    got = {(r.lookback, r.combo, r["top"]): r for r in grids.portfolio_grid({5: d, 7: d.where("code < 5")}, ["a", "b"], WEIGHTS, (1, 3)).collect()}
    assert len(got) == 2 * 3 * 2
    for (lookback, k, n), r in got.items():
        path = []
        for day in sorted({x[1] for x in local}):
            mine = [x for x in local if x[1] == day and x[4] is not None and (lookback == 5 or x[0] < 5) and (x[3] is not None or WEIGHTS[k][1] == 0)]
            mine.sort(key=lambda x: (-round(x[2] * WEIGHTS[k][0] + (x[3] or 0) * WEIGHTS[k][1], 9), x[0]))
            path += [np.mean([x[4] / 50 for x in mine[:n]])] if mine else []
        nav = np.cumsum(np.log1p(path))
        assert r.n_days == len(path) and r.log_return == pytest.approx(nav[-1])
        fall = np.expm1(nav - np.maximum(np.maximum.accumulate(nav), 0)).min()
        assert r.max_drawdown == pytest.approx(fall) and r.eligible == (fall > -0.35)
        assert r.sharpe == pytest.approx((np.mean(path) - 0.02 / 252) / np.std(path, ddof=1) * np.sqrt(252))

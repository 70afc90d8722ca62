"""Carried features, folds, model versions, weekly fits and data as of its date on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_merge
from tidemark.operators import dependence as dep, fundamentals as fun, indicators as ind
from tidemark.plans import folds as fd, layers, weekly
from tidemark.sources import carried

RNG = np.random.default_rng(3)


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r[: len(keys) or 2]))


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        for u, v in zip(x[2:], y[2:]):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-7, abs=1e-9)), (x, y)


# ---- carried store -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sparse_bars(spark):
    """A daily code, one every ninth day (its windows reach back years), one that starts late, one that stops early."""
    days = {"a": range(0, 900), "b": range(0, 900, 9), "c": range(700, 900), "d": range(0, 100), "e": [899]}
    data = [(k, day(i), float(np.round(RNG.lognormal(3, 0.2), 2)), float(RNG.integers(1, 99))) for k, v in days.items() for i in v]
    return spark.createDataFrame(data, "code string, dt date, close double, vol double").cache()


def in_steps(spark, bars, path, steps):
    recipe = carried.trend_recipe()
    for step in steps:
        carried.refresh(spark, path, recipe, bars.where(F.col("dt") <= F.lit(day(step))))
    return carried.stored_features(spark, path)


def test_many_refreshes_equal_one(spark, sparse_bars, tmp_path):
    once = in_steps(spark, sparse_bars, str(tmp_path / "once"), [899])
    many = in_steps(spark, sparse_bars, str(tmp_path / "many"), [0, 50, 350, 700, 701, 899])
    columns = [c for c in once.columns if c != "year"]
    a, b = rows(once.select(columns)), rows(many.select(columns))
    assert len(a) == sparse_bars.count()
    close_to(a, b)
    # and equal the plain windows over the whole history
    plain = ind.macd(sparse_bars.select("code", "dt", "close")).join(ind.run_lengths(sparse_bars).select("code", "dt", "up_run", "down_run"), ["code", "dt"])
    plain = plain.join(dep.expanding_autocorr(sparse_bars, (1,)), ["code", "dt"])
    names = ["code", "dt", "macd_dif", "macd_signal", "macd_hist", "up_run", "down_run", "autocorr_1d"]
    close_to(rows(many.select(names)), rows(plain.select(names)))


def test_refresh_is_repeated_after_a_failure(spark, sparse_bars, tmp_path):
    path, recipe = str(tmp_path / "store"), carried.trend_recipe()
    early = sparse_bars.where(F.col("dt") <= F.lit(day(600)))
    assert carried.refresh(spark, path, recipe, early) == 1
    # features of a second batch are there, its state is not: readers do not see it and the next refresh replaces it
    carried.stored_features(spark, path).where("code = 'a'").write.partitionBy("year").parquet(f"{path}/features/batch=2")
    assert carried.stored_features(spark, path).count() == early.count()
    assert carried.refresh(spark, path, recipe, sparse_bars) == 2
    assert carried.stored_features(spark, path).count() == sparse_bars.count()
    # what is known, late or without a key changes nothing
    odd = spark.createDataFrame([("a", day(3), 1.0, 1.0), ("b", day(1), 1.0, 1.0), (None, day(2000), 1.0, 1.0), ("b", None, 1.0, 1.0)], sparse_bars.schema)
    assert carried.refresh(spark, path, recipe, sparse_bars.unionByName(odd)) == 2
    # a repeated new row counts once
    new = spark.createDataFrame([("b", day(950), 5.0, 1.0)] * 2, sparse_bars.schema)
    assert carried.refresh(spark, path, recipe, new) == 3
    assert carried.stored_features(spark, path).where(F.col("dt") == F.lit(day(950))).select("n_bars").collect() == [(101,)]
    assert carried.batches(spark, path) == [2, 3]  # older states are gone


def test_empty_store(spark, sparse_bars, tmp_path):
    path = str(tmp_path / "store")
    assert carried.refresh(spark, path, carried.trend_recipe(), sparse_bars.where("false")) == 0
    with pytest.raises(ValueError):
        carried.stored_features(spark, path)


# ---- folds -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    data = []
    for code in range(4):
        for i in range(0, 400, 1 + code):  # thin codes look further ahead
            data.append((code, day(i), float(RNG.random()), float(RNG.random()), float(RNG.random()), int(RNG.integers(0, 3)), float(RNG.normal())))
    return spark.createDataFrame(data, "code long, dt date, p0 double, p1 double, p2 double, y int, ret double").cache()


def test_fold_counts_and_rows(panel):
    plan = fd.FoldPlan(train0=120, val=70, step=50, gap=5, horizon=10)  # validations overlap
    d = fd.placed(panel, plan).withColumn("y", F.when(F.col("p0") > 0.1, F.col("y")))
    got = {r.fold: r for r in fd.fold_counts(d, panel, plan, "y").collect()}
    local = d.collect()
    assert sorted(got) == list(range((400 - 70 - 5 - 120) // 50 + 1))
    for k, r in got.items():
        assert (r.train_end, r.val_first, r.val_last) == (120 + 50 * k, 126 + 50 * k, 195 + 50 * k)
        assert (r.train_end_dt, r.val_last_dt) == (day(119 + 50 * k), day(194 + 50 * k))
        assert r.n_train == sum(x.y is not None and x.end_idx is not None and x.date_idx <= r.train_end and x.end_idx < r.val_first for x in local)
        assert r.n_val == sum(x.y is not None and r.val_first <= x.date_idx <= r.val_last for x in local)
    assert fd.fold_counts(d, panel.where(F.col("dt") < F.lit(day(100))), plan, "y").count() == 0


def brute_auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_class_metrics_and_spread(spark, panel):
    d = panel.withColumn("fold", (F.col("code") % 2).cast("int")).withColumns({c: F.round(c, 1) for c in ("p0", "p1", "p2")})
    d = d.withColumn("y", F.when(F.col("fold") == 1, F.greatest("y", F.lit(1))).otherwise(F.col("y")))  # class 0 is absent in fold 1
    local = d.collect()
    for r in fd.class_metrics(d, {0: "p0", 1: "p1", 2: "p2"}, "y").collect():
        mine = [x for x in local if x.fold == r.fold]
        areas = [brute_auc([(x[f"p{k}"], x.y == k) for x in mine]) for k in range(3)]
        known = [a for a in areas if a is not None]
        hits = np.mean([int(np.argmax([x.p0, x.p1, x.p2])) == x.y for x in mine])
        assert r.n_val == len(mine) and r.accuracy == pytest.approx(hits) and r.auc == pytest.approx(np.mean(known))
        assert [r.auc_0, r.auc_1, r.auc_2] == [a if a is None else pytest.approx(a) for a in areas]
    for r in fd.median_spread(d, "p0", "ret", n=7).collect():
        mine = [x for x in local if x.fold == r.fold]
        top = sorted(mine, key=lambda x: (-x.p0, x.dt, x.code))[:7]
        low = sorted(mine, key=lambda x: (x.p0, x.dt, x.code))[:7]
        assert r.spread == pytest.approx(np.median([x.ret for x in top]) - np.median([x.ret for x in low]))
    assert fd.median_spread(d, "p0", "ret", n=10_000).first().spread == 0


def test_walk_forward_does_not_look_ahead(spark):
    """The label equals a feature up to a date and its opposite after: a model that saw later labels would not fail there."""
    data = [(c, day(i), float((i * 7 + c) % 2), int((i * 7 + c) % 2) if i < 150 else 1 - (i * 7 + c) % 2) for c in range(3) for i in range(260)]
    d = spark.createDataFrame(data, "code long, dt date, x double, y int").withColumn("rule", F.lit(1))
    plan = fd.FoldPlan(train0=80, val=30, step=60, gap=5, horizon=5)
    p = fd.walk_forward_direction(fd.placed(d, plan), d, plan, ["x"], "y", ["rule"], rounds=1, depth=1)
    got = {r.fold: r for r in fd.direction_metrics(p, "y", "prob", "rule").collect()}
    assert got[0].accuracy == 1.0 and got[0].auc == 1.0 and got[0].beat == pytest.approx(1 - got[0].rule_accuracy)
    assert got[1].accuracy < 0.5


def test_sector_rule(spark):
    data = [(c, day(i), v, m, 1.0) for i, vals in enumerate([[10, 20, 30, 40, 50, 60, 70], [5, 5, 5, 9, 9, 9, 9], [None] * 7]) for c, (v, m) in enumerate((x if x is None else float(x), 3.0) for x in vals)]
    d = fd.sector_rule(spark.createDataFrame(data, "code long, dt date, rsi_14 double, mom20 double, atr_pct double"))
    got = {(r.dt, r.code): r for r in d.collect()}
    assert [got[day(0), c].rule_tercile for c in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    assert {got[day(1), c].rule_tercile for c in range(7)} == {1}  # two different scores
    assert {got[day(2), c].rule_outperform for c in range(7)} == {0}


# ---- versions and layers -----------------------------------------------------------------------


def test_versions_score_only_later_dates(spark):
    days = spark.createDataFrame([(day(i),) for i in range(30)], "dt date")
    made = {r.version: r.asof_dt for r in layers.version_dates(days, "2020-01-11", 7).collect()}
    assert made == {0: day(9), 1: day(16), 2: day(23)}
    got = {r.dt: r for r in layers.newest_version(days, layers.version_dates(days, "2020-01-11", 7)).collect()}
    assert sorted(got) == [day(i) for i in range(10, 30)]
    assert all(r.asof_dt < d and r.version == (d - day(10)).days // 7 for d, r in got.items())
    # stored versions on odd dates, one of them later than all days
    odd = spark.createDataFrame([(4, day(3)), (5, day(4)), (9, day(99))], "version int, asof_dt date")
    assert {r.dt: r.version for r in layers.newest_version(days, odd).collect()} == {day(4): 4} | {day(i): 5 for i in range(5, 30)}


def test_scores_by_version(spark):
    from tidemark.plans.models import fit_regressor

    rows_ = spark.createDataFrame([(i % 3, float(i % 5), float(i % 5 * (1 + i % 3))) for i in range(90)], "version int, x double, y double")
    models = {v: fit_regressor(rows_.where(F.col("version") == v), ["x"], "y", rounds=2) for v in (0, 1)}
    got = layers.score_by_version(rows_, models).collect()
    assert {r.version for r in got} == {0, 1} and all(abs(r.prediction - r.y) < 1e-6 for r in got)


def test_layered_picks(spark):
    market = spark.createDataFrame([(day(0), 0.7), (day(1), 0.3), (day(2), None)], "dt date, up_prob double")
    sectors = spark.createDataFrame([(day(i), s, p) for i in range(4) for s, p in (("a", 0.9), ("b", 0.9), ("c", 0.1), ("d", None))], "dt date, sector string, prob double")
    data = [(day(i), 10 * k + j, s, p, 1 - p, None if j == 0 else 0.8, i) for i in range(5) for k, s in enumerate("abcd") for j, p in enumerate((0.2, 0.6, 0.9))]
    inst = spark.createDataFrame(data, "dt date, code long, sector string, p_momentum double, p_reversion double, p_breakout double, extra int")
    got = {}
    for r in layers.layered_picks(market, sectors, inst, n_sectors=2, n=3).collect():
        got.setdefault((r.dt, r.regime), []).append((r.rank, r.code, r.extra))
    assert {k: sorted(v) for k, v in got.items()} == {
        (day(0), "bull"): [(1, 2, 0), (2, 12, 0), (3, 1, 0)],
        (day(1), "bear"): [(1, 1, 1), (2, 2, 1), (3, 11, 1)],
        (day(2), "range"): [(1, 0, 2), (2, 10, 2)],
        (day(3), "range"): [(1, 0, 3), (2, 10, 3)],
    }  # day 4 has no industries


# ---- weekly fits -------------------------------------------------------------------------------


def test_weekly_windows_rows_and_fits(spark):
    data = [(c, day(i), float(RNG.normal()), float(RNG.normal()), None if RNG.random() < 0.05 else float(RNG.normal())) for c in range(3) for i in range(0, 150, 1 + c)]
    d = weekly.with_outcome_date(spark.createDataFrame(data, "code long, dt date, x double, z double, y double"), 3)
    windows = weekly.weekly_windows(d, 4)
    local, weeks = d.collect(), {r.week: r for r in windows.collect()}
    monday = lambda x: x - dt.timedelta(days=x.weekday())
    assert min(weeks) == monday(day(0)) + dt.timedelta(weeks=4)
    counts = {r.week: r for r in weekly.window_counts(d, windows, "y", 4).collect()}
    train = weekly.window_rows(d, windows, 4)
    fits = {r.week: r for r in weekly.weekly_ridge(train, ["x", "z"], "y", penalty=2.0, min_rows=20).collect()}
    assert fits
    for week in weeks:
        mine = [r for r in local if r.y is not None and r.end_dt is not None and week - dt.timedelta(weeks=4) <= r.dt < week and r.end_dt < week]
        assert counts[week].n_train == len(mine)
        assert counts[week].n_val == sum(r.y is not None and monday(r.dt) == week for r in local)
        if len(mine) >= 20:
            x = np.array([[1.0, r.x, r.z] for r in mine])
            w = np.linalg.solve(x.T @ x + np.diag([0.0, 2.0, 2.0]), x.T @ np.array([r.y for r in mine]))
            assert [fits[week].intercept, *fits[week].weights] == pytest.approx(w.tolist())
    val = weekly.scored(weekly.validation_rows(d, windows), weekly.weekly_ridge(train, ["x", "z"], "y", penalty=2.0, min_rows=20), ["x", "z"])
    for r in val.collect():
        f = fits[r.week]
        assert r.pred == pytest.approx(f.intercept + f.weights[0] * r.x + f.weights[1] * r.z)
    ic = {r.week: r for r in weekly.weekly_ic(val, "pred", "y", min_rows=5).collect()}
    known = val.where("y is not null").toPandas()
    for week, r in ic.items():
        mine = known[known["week"] == week]
        boosted = mine["pred"].where(mine["y"] <= 2, mine["pred"] * 2)
        assert r.n == len(mine) and r.ic_plain == pytest.approx(mine["pred"].rank().corr(mine["y"].rank()))
        assert r.ic_boosted == pytest.approx(boosted.rank().corr(mine["y"].rank()))
        above = mine[mine["pred"] > mine["pred"].mean()]
        assert r.win_rate == pytest.approx((above["y"] > 0).mean())
    assert set(ic) == {w for w in known["week"] if (known["week"] == w).sum() >= 5}


# ---- data as of its date -----------------------------------------------------------------------


def test_asof_merge(spark):
    left = spark.createDataFrame([("a", day(5), 1), ("a", day(5), 2), ("a", day(1), 3), ("b", day(9), 4), (None, day(9), 5)], "code string, dt date, n int")
    one = spark.createDataFrame([("a", day(5), 50.0), ("a", day(6), 60.0), ("a", day(2), None)], "code string, known date, v double")
    two = spark.createDataFrame([("b", day(3), 7), ("b", None, 8)], "code string, dt date, w int")
    got = {r.n: (r.one_dt, r.v, r.two_dt, r.w) for r in asof_merge(left, {"one": (one, "known", ["v"]), "two": (two, "dt", ["w"])}).collect()}
    assert got == {1: (day(5), 50.0, None, None), 2: (day(5), 50.0, None, None), 3: (None,) * 4, 4: (None, None, day(3), 7), 5: (None,) * 4}


def test_statements_do_not_look_ahead(spark):
    keys = spark.createDataFrame([("a", day(i)) for i in (0, 99, 100, 300, 700)], "code string, dt date")
    st = spark.createDataFrame(
        [("a", day(-20), day(100), 10.0, 5.0, 3.0, 2.0, 1.0, "1"), ("a", day(345), None, 20.0, 5.0, 0.0, 2.0, -2.0, "1"), ("a", day(344), None, 99.0, 9.0, 9.0, 9.0, 9.0, "2")],
        "code string, end_date date, ann_date date, revenue double, n_income double, cfo double, capex double, fcf double, report_type string",
    )
    value = spark.createDataFrame([("a", day(99), -3.0, None)], "code string, dt date, pe_ttm double, pb double")
    got = {r.dt: r for r in fun.external_features(keys, value, st, values=("pe_ttm", "pb", "earnings_yield")).collect()}
    assert [got[day(i)].net_profit_margin for i in (0, 99, 100, 300, 700)] == [None, None, 0.5, 0.5, 0.25]
    assert [got[day(i)].statement_dt for i in (99, 100, 700)] == [None, day(100), day(465)]
    assert got[day(700)].revenue_growth == pytest.approx(100.0) and got[day(700)].statement_age == 355 and got[day(300)].revenue_growth is None
    assert (got[day(0)].pe_ttm, got[day(0)].earnings_yield) == (None, None) and (got[day(99)].pe_ttm, got[day(99)].earnings_yield, got[day(99)].pb) == (-3.0, 0.0, None)


def test_expanding_statistics_use_only_the_past(spark, make_bars):
    closes = list(RNG.lognormal(3, 0.1, 80))
    whole = rows(dep.expanding_statistics(make_bars({"a": closes})))
    part = rows(dep.expanding_statistics(make_bars({"a": closes[:50]})))
    close_to(whole[:50], part)
    r = np.diff(closes) / np.array(closes[:-1]) * 100
    n, up = 79, int((r > 0).sum())
    s5 = np.convolve(r, np.ones(5), "valid")[1:]
    gain, loss = r[r > 0].std(), r[r < 0].std()
    expected = [s5.var(ddof=1) / (5 * r.var(ddof=1)), (((r[1:] > 0) != (r[:-1] > 0)).sum() + 1) / (2 * up * (n - up) / n + 1), gain / max(1, loss)]
    assert list(whole[-1][2:]) == pytest.approx(expected) and whole[29][2] is None and whole[30][2] is not None


def test_run_lengths(make_bars):
    got = [(r.up_run, r.down_run) for r in ind.run_lengths(make_bars({"a": [*range(1, 31), 29, 28, 28, 29]})).orderBy("dt").collect()]
    assert got == [*((i, 0) for i in range(30)), (0, 1), (0, 2), (0, 0), (1, 0)]


def test_factor_quantiles(spark):
    from tidemark.operators.studies import factor_quantiles

    data = [(float(RNG.integers(0, 8)), None if RNG.random() < 0.2 else float(RNG.normal()), None if RNG.random() < 0.1 else float(RNG.normal())) for _ in range(300)]
    got = {(r.factor, r.bucket): r for r in factor_quantiles(spark.createDataFrame(data, "a double, b double, y double"), ["a", "b"], "y").collect()}
    for i, name in enumerate(("a", "b")):
        rows_ = [(x[i], x[2]) for x in data if x[i] is not None and x[2] is not None]
        edges = np.quantile([x for x, _ in rows_], [0.25, 0.5, 0.75])
        by = {k: [y for x, y in rows_ if (x > edges).sum() == k] for k in range(4)}
        for k, ys in by.items():
            if not ys:
                assert (name, k) not in got
                continue
            r = got[name, k]
            assert r.n == len(ys) and r.avg_return == pytest.approx(np.mean(ys)) and r.win_rate == pytest.approx(np.mean(np.array(ys) > 0) * 100)
            assert r.spread == pytest.approx(np.mean(by[3]) - np.mean(by[0]))


def test_refresh_shuffles_its_rows_once(spark, sparse_bars, tmp_path):
    recipe = carried.trend_recipe()
    first, tail, carry = carried.advance(recipe, sparse_bars.where(F.col("dt") <= F.lit(day(600))), None, None)
    assert {r.code: r["dt"] for r in tail.where("_state is not null").collect()} == {r.code: r["dt"] for r in carry.collect()}
    stored = spark.read.parquet(first._source._table_path)
    assert stored.where("_state is not null").count() == 3  # the state is kept once a code
    # a tail without the state, as stores had it, gives the same
    new = sparse_bars.where(F.col("dt") > F.lit(day(600)))
    got = [rows(carried.advance(recipe, new, t, carry)[0]) for t in (tail, tail.drop("_state"))]
    close_to(*got)
    assert len(got[0]) == new.count()
    plan = carried.advance(recipe, new, tail, carry)[1]
    assert plan.where("code = 'd'").count() == 100 and plan.where("code = 'd' and _state is not null").count() == 1

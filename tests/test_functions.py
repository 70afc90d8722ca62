"""Window, rank and smoothing building blocks against brute force in pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_join
from tidemark.functions.ewm import span_rate, wilder_rate, with_ewm
from tidemark.functions.ranks import exact_percentiles, with_pct_rank, with_pct_ranks, with_position
from tidemark.functions.windows import kurt_n, skew_n
from tidemark.operators import indicators as ind


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    return {"A": list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))), "B": list(50 * np.exp(np.cumsum(rng.normal(0, 0.03, 70)))), "ONE": [7.0]}


def test_ewm_matches_recursion(spark, make_bars, noisy):
    out = with_ewm(make_bars(noisy), {"e": ("close", span_rate(12)), "w": ("close", wilder_rate(14))}).toPandas().sort_values(["code", "dt"])
    for _, g in out.groupby("code"):
        np.testing.assert_allclose(g["e"], g["close"].ewm(span=12, adjust=False).mean(), rtol=1e-10)
        np.testing.assert_allclose(g["w"], g["close"].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-10)


def test_ewm_over_block_borders(spark, make_bars):
    closes = list(100 + 10 * np.sin(np.arange(2600) / 9.0))
    out = with_ewm(make_bars({"L": closes}), {"e": ("close", span_rate(26))}).toPandas().sort_values("dt")
    np.testing.assert_allclose(out["e"], out["close"].ewm(span=26, adjust=False).mean(), rtol=1e-9)


def test_ewm_skips_leading_nulls(spark, make_bars):
    d = make_bars({"A": [1.0, 2.0, 4.0, 3.0, 5.0]}).withColumn("x", F.when(F.col("close") > 1, F.col("close")))
    got = with_ewm(d, {"e": ("x", 0.25)}).orderBy("dt").toPandas()["e"]
    want = pd.Series([np.nan, 2.0, 4.0, 3.0, 5.0]).ewm(alpha=0.25, adjust=False).mean()
    np.testing.assert_allclose(got.to_numpy(dtype=float), want, rtol=1e-12)


def test_pct_rank_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 400 + ["a"] * 50 + ["b"] * 3, "id": range(453)})
    pdf["x"] = np.where(rng.random(453) < 0.4, 0.0, np.round(rng.normal(0, 5, 453), 1))
    pdf.loc[450:, "x"] = 2.5
    got = with_pct_rank(spark.createDataFrame(pdf), ["g"], "x", "r").toPandas().sort_values("id")
    want = pdf.groupby("g")["x"].rank(pct=True) * 100
    np.testing.assert_allclose(got["r"], want)


def test_several_ranks_keep_nulls_out(spark):
    pdf = pd.DataFrame({"g": [1, 1, 1, 2, 2], "id": range(5), "x": [3.0, None, 1.0, 4.0, 4.0], "y": [1.0, 2.0, 2.0, -5.0, 9.0]})
    d = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = with_pct_ranks(d, ["g"], ["g", "id"], {"rx": "x", "ry": "y"}, constant=0.0).toPandas().sort_values("id")
    np.testing.assert_allclose(got["rx"].to_numpy(dtype=float), [100.0, np.nan, 50.0, 0.0, 0.0])
    np.testing.assert_allclose(got["ry"], [100 / 3, 250 / 3, 250 / 3, 50.0, 100.0])


def test_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "x": np.round(rng.normal(0, 100, 500), 0)})
    got = exact_percentiles(spark.createDataFrame(pdf), ["g"], "x", {"q1": 0.25, "m": 0.5, "t": 0.9}).toPandas().set_index("g").sort_index()
    for name, q in (("q1", 0.25), ("m", 0.5), ("t", 0.9)):
        np.testing.assert_allclose(got[name], pdf.groupby("g")["x"].quantile(q).sort_index())


def test_position_is_a_permutation_in_order(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(300), "x": np.round(rng.normal(0, 3, 300), 1)})
    got = with_position(spark.createDataFrame(pdf), "x", "id").toPandas()
    want = pdf.sort_values(["x", "id"])["id"].tolist()
    assert got.sort_values("pos")["id"].tolist() == want and sorted(got["pos"]) == list(range(1, 301))


def test_skew_and_kurtosis_match_pandas(spark, make_bars, noisy):
    d = ind.daily_return(make_bars(noisy)).select("*", skew_n("ret", 20, 5).alias("s"), kurt_n("ret", 20, 5).alias("k"))
    for _, g in d.toPandas().sort_values(["code", "dt"]).groupby("code"):
        np.testing.assert_allclose(g["s"].to_numpy(dtype=float), g["ret"].rolling(20, min_periods=5).skew(), rtol=1e-6)
        np.testing.assert_allclose(g["k"].to_numpy(dtype=float), g["ret"].rolling(20, min_periods=5).kurt(), rtol=1e-6)


def test_constant_series_has_no_skew(spark, make_bars):
    d = ind.daily_return(make_bars({"C": [5.0] * 30}))
    assert d.select(skew_n("ret", 20, 5).alias("s")).where("s is not null").count() == 0


def test_asof_takes_newest_not_later(spark):
    day = lambda d: dt.date(2020, 1, d)
    left = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("b", day(3))], "k string, dt date")
    right = spark.createDataFrame([("a", day(2), 1.0), ("a", day(5), 2.0), ("c", day(1), 9.0)], "k string, dt date, v double")
    got = {(r.k, r.dt): r.v for r in asof_join(left, right, "k", "dt", ["v"]).collect()}
    assert got == {("a", day(1)): None, ("a", day(5)): 2.0, ("b", day(3)): None}
    strict = {(r.k, r.dt): r.v for r in asof_join(left, right, "k", "dt", ["v"], allow_equal=False).collect()}
    assert strict[("a", day(5))] == 1.0


def test_windows_never_read_the_future(spark, make_bars, noisy):
    changed = {k: (v[:60] + [x * 3 for x in v[60:]]) for k, v in noisy.items()}
    limit = dt.date(2020, 1, 1) + dt.timedelta(days=59)

    def run(series):
        d = ind.macd(ind.return_stats(ind.daily_return(ind.moving_averages(ind.momenta(make_bars(series))))))
        return d.where(F.col("dt") <= F.lit(limit)).orderBy("code", "dt").toPandas()

    pd.testing.assert_frame_equal(run(noisy), run(changed))


def test_partition_count_does_not_matter(spark, make_bars, noisy):
    d = make_bars(noisy)
    a = ind.rsi_wilder(d.repartition(1)).orderBy("code", "dt").toPandas()
    b = ind.rsi_wilder(d.repartition(7)).orderBy("code", "dt").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_ewm_interior_nulls_and_any_rate(spark, make_bars):
    gaps = F.when(~F.dayofyear("dt").isin(1, 4, 5, 31), F.col("close"))
    d = make_bars({"A": [float(10 + (7 * i) % 13) for i in range(60)]}).withColumn("x", gaps)
    spans = {"s1": 1, "s3": 3, "s62": 62, "s500": 500}
    out = with_ewm(d, {k: ("x", span_rate(n)) for k, n in spans.items()}).toPandas().sort_values("dt")
    for k, n in spans.items():
        np.testing.assert_allclose(out[k], out["x"].ewm(span=n, adjust=False, ignore_na=True).mean(), rtol=1e-9)


def test_ranks_ignore_nan(spark):
    d = spark.createDataFrame([("g", float(x)) for x in (1, 2, float("nan"), 5)], "g string, v double")
    from tidemark.functions.ranks import tie_table

    got = {r.x: (r.n_below, r.n_group) for r in tie_table(d, ["g"], "v").collect()}
    assert got == {1.0: (0, 3), 2.0: (1, 3), 5.0: (2, 3)}


def test_ranks_between_splitters(spark):
    """Values in a narrow range, tiny ones, one value with a third of the rows, NULLs; many buckets and one."""
    from tidemark.functions.ranks import tie_table, with_bucket, with_place

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0.50, 0.52, 500), rng.uniform(-1e-9, 1e-9, 400), np.zeros(450), rng.normal(0, 1e6, 50)])
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(x)), "id": rng.permutation(len(x)), "x": x, "_n": 1})
    pdf.loc[::40, "x"] = None
    d = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).select("g", "id", "x")
    filled = pdf.dropna(subset="x")
    below = {(g, v): int((h["x"] < v).sum()) for g, h in filled.groupby("g") for v in set(h["x"])}
    for per in (1, 7, 1 << 16):
        t = tie_table(d, ["g"], "x", per).collect()
        assert {(r.g, r.x): r.n_below for r in t} == below and len(t) == len(below)
        whole = tie_table(d, [], "x", per).collect()
        assert {r.x: r.n_below for r in whole} == {v: int((filled["x"] < v).sum()) for v in set(filled["x"])}
        got = with_place(d, ["g"], [F.col("x"), F.col("id")], "p", "n", per).toPandas()
        for g, h in got.groupby("g"):
            want = h.sort_values(["x", "id"], na_position="first")["id"].tolist()
            assert h.sort_values("p")["id"].tolist() == want and set(h["n"]) == {len(h)} and sorted(h["p"]) == list(range(1, len(h) + 1))
        pos = with_position(d, "x", "id", per_bucket=per).toPandas()
        assert pos.sort_values("pos")["id"].tolist() == pos.sort_values(["x", "id"], na_position="first")["id"].tolist()
    sizes = with_bucket(d, ["g"], [F.col("x"), F.col("id")], 10).groupBy("g", "_b").count().toPandas()
    assert sizes["count"].max() < 120  # the value with a third of the rows is parted too
    assert tie_table(d.where("false"), ["g"], "x").collect() == [] and with_position(d.where("false"), "x", "id").collect() == []


def test_correlation_of_a_constant_is_null(spark):
    from tidemark.functions.scalar import corr

    d = spark.createDataFrame([(1.0, 2.0, 0.1), (2.0, 1.0, 0.1), (4.0, 0.5, 0.1), (9.0, None, 0.1)], "a double, b double, k double")
    r = d.agg(corr("a", "b").alias("ab"), corr("a", "k").alias("ak")).first()
    assert abs(r.ab - d.where("b is not null").stat.corr("a", "b")) < 1e-12 and r.ak is None


def test_fold_correlations_of_constant_shares(spark, monkeypatch):
    from tidemark.catalog import studies

    rows = [(0.1, 0.2, 0.3, 0.0), (0.2, 0.5, 0.1, 0.0), (0.4, 0.1, 0.2, 0.0)]
    folds = spark.createDataFrame(rows, "hhi double, t1_wr double, d5_wr double, gate_blocked double")
    monkeypatch.setattr(studies, "fold_frame", lambda spark, base: folds)
    r = studies.fold_correlations(spark, "").first()
    assert r.gate_t1 != r.gate_t1 and r.gate_d5 != r.gate_d5 and r.hhi_t1 == round(folds.stat.corr("hhi", "t1_wr"), 6)


def test_ewm_stages_share_sorts_and_match_recursion(spark, make_bars):
    from tidemark.functions.ewm import with_ewm_stages

    rng = np.random.default_rng(11)
    d = make_bars({"A": list(rng.lognormal(3, 0.3, 6100)), "B": [1.0, 2.0, 3.0]})
    d = d.withColumn("x", F.when(F.pmod(F.dayofyear("dt"), F.lit(7)) > 1, F.col("close"))).withColumn("y", F.col("x") * F.col("x"))
    stages = [{"ex": ("x", span_rate(12)), "ey": ("y", span_rate(26))}, {"s": (F.col("ex") - F.sqrt("ey"), span_rate(9))}]
    plain = with_ewm(with_ewm(d, stages[0]).withColumn("z", F.col("ex") - F.sqrt("ey")), {"s": ("z", span_rate(9))})
    staged = with_ewm_stages(d, stages, together=True)
    a, b = (t.orderBy("code", "dt").toPandas() for t in (plain, staged))
    assert staged.columns == [*d.columns, "ex", "ey", "s"]
    for _, g in b.groupby("code"):
        for out, x, n in (("ex", g["x"], 12), ("ey", g["y"], 26), ("s", g["ex"] - np.sqrt(g["ey"]), 9)):
            np.testing.assert_allclose(g[out], x.ewm(span=n, adjust=False, ignore_na=True).mean(), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(a["s"], b["s"], rtol=1e-8, atol=1e-10)


def test_smoothed_indicators_sort_once_a_stage(spark, make_bars):
    d = make_bars({"A": [float(i % 7 + 1) for i in range(40)]})
    for f, most in ((lambda x: ind.macd(x), 3), (lambda x: ind.rsi_wilder(x), 2), (lambda x: ind.rsi_ewm14(ind.daily_return(x)), 2)):
        plan = f(d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" Sort [") <= most, plan

"""Operators on small hand-made panels."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import dependence as dep, indicators as ind, joins, predicates as rule, pullbacks as pb, routing, studies as st, text
from tidemark.plans import backtests as bt, models as md
from tidemark.sources import bars as src, ingest, store


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def test_bars_from_ticks_use_the_tick_order(spark):
    rows = [(1, day(0), 10.0, 2.0, 20.0, 3, 1, 1), (1, day(0), 12.0, 1.0, 12.0, 1, 2, 1), (1, day(0), 9.0, 1.0, 9.0, 1, 1, 7), (1, day(0), 8.0, 1.0, 8.0, 1, 1, 9)]
    t = spark.createDataFrame(rows, "code long, dt date, px double, qty double, amt double, l_orderkey long, l_linenumber int, l_partkey long")
    r = src.build_bars(t, ["code", "dt"], "px", "qty", "amt", src.tick_order()).first()
    assert (r.open, r.high, r.low, r.close, r.vol, r.amount) == (9.0, 12.0, 8.0, 10.0, 5.0, 49.0)


def test_volume_spike_flags(spark, make_bars):
    vols = {"UP": [100.0] * 39 + [220.0], "DN": [100.0] * 39 + [50.0]}
    d = ind.volume_spike(make_bars({"UP": [10.0] * 40, "DN": [10.0] * 40}, vol=vols)).where("is_snapshot")
    got = {r.code: (r.vol_spike > 1.5, r.vol_spike < 0.7) for r in d.collect()}
    assert got == {"UP": (True, False), "DN": (False, True)}


def test_guard_rejects_intraday_and_counts_duplicates(spark):
    d = spark.createDataFrame([("a", day(0), 1.0, 5.0), ("a", day(0), 1.0, -5.0), ("b", day(0), None, 1.0)], "code string, dt date, close double, vol double")
    r = ingest.bar_violations(d).first()
    assert (r.rows, r.duplicate_keys, r.missing_close, r.negative_vol) == (3, 1, 1, 1)
    try:
        ingest.bar_violations(d.withColumn("time", F.lit("9:30")))
        raise AssertionError("an intraday column must be refused")
    except ValueError:
        pass


def test_alpha_decay_cuts_only_the_fallen(spark):
    d = spark.createDataFrame([("a", 0.80, 0.78), ("b", 0.62, 0.40), ("c", 0.5, None)], "code string, p0 double, p1 double")
    got = {r.code: r.alpha_decay_cut for r in d.select("code", *[e.alias(n) for n, e in rule.alpha_decay("p0", "p1").items()]).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_gap_risk_and_its_panel_form_agree(spark):
    rows = []
    for code, nxt in (("bad", -2.0), ("good", 2.0)):
        px = 100.0
        for i in range(70):
            jump = i % 8 == 3
            open_ = px * (1 + (nxt / 100 if i % 8 == 4 else 0.0))
            close = px * (1.06 if jump else 1.0)
            rows.append((code, day(i), open_, max(open_, close), min(open_, close), close, 1.0, close))
            px = close
    p = src.with_change(spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, vol double, amount double"))
    got = {r.code: r.score for r in routing.gap_risk(p).collect()}
    assert got["bad"] > 0.8 and got["good"] == 0.0
    last = {r.code: r.t1_lock_risk for r in routing.gap_risk_panel(p).where(F.col("dt") == F.lit(day(69))).collect()}
    assert last == got


def test_gap_penalty_hits_high_risk_only(spark):
    s = spark.createDataFrame([("a", 80.0), ("b", 75.0), ("c", 70.0)], "code string, score double")
    r = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.45)], "code string, score double")
    got = {x.code: x.score for x in routing.with_gap_penalty(s, r, "score").collect()}
    assert got == {"a": 65.0, "b": 75.0, "c": 55.0}


def test_labels_follow_the_two_percent_borders(spark, make_bars):
    d = md.ordinal_labels(make_bars({"A": [100.0, 97.0, 99.0, 110.0]}), horizon=1).orderBy("dt")
    assert [(r.y_label, r.weight) for r in d.collect()] == [(0, 2.0), (2, 1.0), (2, 1.0), (None, None)]


def test_rank_ic_of_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    rows = [(day(d), f"c{i}", float(x), float(x + rng.normal(0, 0.1))) for d in range(3) for i, x in enumerate(rng.normal(0, 1, 30))]
    s = spark.createDataFrame(rows, "dt date, code string, p double, a double")
    ic = st.rank_ic(s, "p", "a").toPandas()
    assert len(ic) == 3 and (ic["ic"] > 0.9).all()
    pdf = s.toPandas()
    want = pdf.groupby("dt").apply(lambda g: g["p"].rank().corr(g["a"].rank()), include_groups=False)
    np.testing.assert_allclose(ic.sort_values("dt")["ic"], want)


def test_nearest_by_score_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    hist = pd.DataFrame({"hist_id": range(400), "score": np.round(rng.normal(0, 10, 400), 2), "outcome": rng.normal(0, 5, 400)})
    cand = pd.DataFrame({"cand_id": range(12), "score": np.round(rng.normal(0, 12, 12), 3)})
    got = joins.nearest_by_score(spark.createDataFrame(cand), spark.createDataFrame(hist), n=25).toPandas().set_index("cand_id")
    for _, c in cand.iterrows():
        d = (hist["score"] - c["score"]).abs().sort_values(kind="stable")
        assert got.loc[c["cand_id"], "n_near"] == 25
        np.testing.assert_allclose(got.loc[c["cand_id"], "max_distance"], d.iloc[24])


def test_first_hit_exit(spark, make_bars):
    bars = make_bars({"A": [100.0, 98.0, 96.0, 99.0, 103.0, 104.0, 90.0]})
    picks = spark.createDataFrame([("A", day(0), 2.0)], "code string, dt date, atr_ratio double")
    got = {r.stop: (r.triggered, r.hold_days, round(r.ret, 6)) for r in bt.stop_exits(picks, bars).collect()}
    assert got["none"] == (False, 5, 4.0) and got["3%"] == (True, 2, -4.0) and got["5%"] == (False, 5, 4.0) and got["1.5xATR"] == (True, 2, -4.0)


def test_pullback_spacing_and_recovery(spark, make_bars):
    closes = [100.0] * 40 + [96.0, 95.0, 94.0, 97.0] + [100.0] * 30
    ev = pb.pullback_events(make_bars({"A": closes})).collect()
    assert [(r.event_dt, r.duration, r.recovery_days) for r in ev] == [(day(40), 2, 1)]


def test_hurst_is_bounded_and_whole(spark, make_bars):
    rng = np.random.default_rng(8)
    d = dep.hurst(make_bars({"A": list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))), "S": [1.0, 2.0, 3.0]})).toPandas().set_index("code")["hurst_exponent"]
    assert d["S"] == 0.5 and 0.01 <= d["A"] <= 0.99


def test_forward_fill_keeps_every_date(spark, make_bars):
    b = make_bars({"A": [1.0, 2.0, 3.0, 4.0], "B": [9.0, 8.0, 7.0, 6.0]}).where(~((F.col("code") == "B") & (F.col("dt") == F.lit(day(2)))))
    got = bt.filled_panel(b).where("code = 'B'").orderBy("dt").toPandas()["close"].tolist()
    assert got == [9.0, 8.0, 8.0, 6.0]


def test_text_tiers_in_default_words(spark):
    d = spark.createDataFrame([("市场恐慌 突破",), ("涨停潮",), ("业绩超预期",), ("大股东减持",), ("无事",)], "t string")
    assert [r.m for r in d.select(text.classify_text("t").alias("m")).collect()] == ["panic", "excited", "positive", "negative", "neutral"]
    assert [r.m for r in d.select(text.classify_title("t").alias("m")).collect()][3] == "⚠️ 减持"


def test_store_roundtrip_update_and_removal(spark, make_bars, tmp_path):
    bars = make_bars({"A": [float(i + 1) for i in range(400)]})
    build = lambda b: b.select("code", "dt", ind.momentum(5).alias("mom5"))
    path = str(tmp_path / "store")
    first = F.lit(day(360))
    store.write_store(build(bars.where(F.col("dt") <= first)), path)
    store.update_store(spark, path, bars, build)
    whole = build(bars).orderBy("dt").toPandas()
    got = spark.read.parquet(path).orderBy("dt").select("code", "dt", "mom5").toPandas()
    pd.testing.assert_frame_equal(got, whole)
    store.remove_date(spark, path, day(50).isoformat(), str(tmp_path / "staging"))
    assert spark.read.parquet(path).count() == 399
    store.write_result(whole_df := build(bars), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == whole_df.count()


def test_stream_appends_each_key_once(spark, make_bars, tmp_path):
    from tidemark.streaming.incremental import append_stream

    bars = make_bars({"A": [1.0, 2.0, 3.0], "B": [5.0, 6.0, 7.0]})
    where = {k: str(tmp_path / k) for k in ("store", "landing", "state")}
    bars.where(F.col("dt") <= F.lit(day(1))).write.parquet(where["store"])
    bars.where(F.col("dt") >= F.lit(day(1))).write.parquet(where["landing"])
    append_stream(spark, where["landing"], bars.schema, where["store"], where["state"]).awaitTermination(120)
    assert spark.read.parquet(where["store"]).count() == 6


def test_model_versions_are_found_by_date(spark, tmp_path):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.normal(0, 1, 200)})
    pdf["y_label"] = np.where(pdf.x > 0.5, 2, np.where(pdf.x < -0.5, 0, 1)).astype(int)
    pdf["weight"] = 1.0
    d = spark.createDataFrame(pdf)
    model = md.fit_engine(d, ["x"], trees=3, depth=3)
    root = str(tmp_path / "models")
    for asof in ("2020-01-10", "2020-02-10"):
        md.save_model(model, root, "momentum", asof)
    assert md.stored_dates(spark, root, "momentum") == ["2020-01-10", "2020-02-10"]
    assert md.load_model(spark, root, "momentum", "2020-01-31") is not None and md.load_model(spark, root, "momentum", "2019-01-01") is None
    assert md.is_stale(spark, root, "momentum", "2020-03-01") and not md.is_stale(spark, root, "momentum", "2020-02-01")
    p = md.win_probability(model, d).toPandas()
    assert p[p.x > 1]["win_prob"].mean() > p[p.x < -1]["win_prob"].mean()


def test_no_training_label_ends_in_validation(spark):
    import datetime as dt

    from tidemark.plans.models import fold_ranges, training_rows, with_label_end

    day = dt.date(2020, 1, 1)
    rows = [("dense", day + dt.timedelta(days=i), 1) for i in range(120)] + [("sparse", day + dt.timedelta(days=5 * i), 1) for i in range(24)]
    labelled = spark.createDataFrame(rows, "code string, dt date, y_label int")
    data = with_label_end(labelled, 5).cache()
    folds = fold_ranges(labelled, 60, 20, 10, 5).collect()
    assert folds and not fold_ranges(labelled, 100, 20, 10, 5).collect()
    for f in folds:
        train = training_rows(data, f.train_end, f.val_first)
        assert train.where(F.col("end_idx") >= f.val_first).count() == 0 and train.where("code = 'sparse'").count() > 0


def test_keyword_filter_takes_words_literally(spark):
    from tidemark.operators.predicates import without_keywords

    d = spark.createDataFrame([("a*b",), ("aab",), (None,), ("(x",)], "name string")
    assert {r.name for r in without_keywords(d, "name", ["*", "("]).collect()} == {"aab", None}


def test_store_update_reaches_back_by_bars(spark, tmp_path):
    """A code with a bar every ninth day needs years for its window; the update is exact all the same."""
    rows = [(k, day(i), float((i * 7919) % 101)) for k, step in (("A", 1), ("B", 9)) for i in range(0, 1200, step)]
    bars = spark.createDataFrame(rows, "code string, dt date, close double")
    build = lambda b: b.select("code", "dt", F.round(ind.mean_n("close", 100, 100), 9).alias("m"))
    path = str(tmp_path / "store")
    store.write_store(build(bars.where(F.col("dt") <= F.lit(day(1000)))), path)
    store.update_store(spark, path, bars, build, buffer_bars=100)
    got = {(r.code, r.dt): r.m for r in spark.read.parquet(path).collect()}
    assert got == {(r.code, r.dt): r.m for r in build(bars).collect()}


def test_stream_by_year_takes_late_bars_and_reads_only_their_years(spark, make_bars, tmp_path):
    from tidemark.streaming.incremental import append_stream_by_year, stored_keys

    bars = make_bars({"A": [float(i) for i in range(1, 1101)]})  # 2020 to 2023
    where = {k: str(tmp_path / k) for k in ("store", "landing", "state")}

    def land(df):
        df.write.mode("append").parquet(where["landing"])
        append_stream_by_year(spark, where["landing"], bars.schema, where["store"], where["state"]).awaitTermination(120)

    land(bars.where("year(dt) <> 2020 or month(dt) = 1"))
    assert spark.read.parquet(where["store"]).count() == bars.where("year(dt) <> 2020 or month(dt) = 1").count()
    land(bars.where("year(dt) = 2022"))  # replayed
    land(bars.where("year(dt) = 2020").unionByName(bars.where("year(dt) = 2020")))  # late, each row twice
    got = spark.read.parquet(where["store"])
    assert got.count() == bars.count() == got.select("code", "dt").distinct().count()
    keys = stored_keys(spark, where["store"], bars.schema, [2021])
    scan = keys._jdf.queryExecution().executedPlan().toString()
    assert keys.count() == 365 and "year" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_recoveries_are_censored_not_never(spark, make_bars):
    from tidemark.operators import pullbacks as pb

    # falls at bar 70, regains that price 320 bars after its low, falls again at bar 421 and stays below
    closes = [100.0] * 70 + [96.0] + [80.0] * 20 + [85.0] * 300 + [97.0] * 30 + [90.0] + [80.0] * 20
    bars = make_bars({"A": closes})
    short = {r.event_dt: r for r in pb.pullback_events(bars).collect()}
    whole = {r.event_dt: r for r in pb.pullback_events(bars, recovery_span=None).collect()}
    assert set(short) == set(whole)
    assert (short[day(70)].recovery_days, short[day(70)].censored) == (-1, False)
    assert (whole[day(70)].recovery_days, whole[day(70)].censored) == (320, False)
    assert [(d[day(421)].recovery_days, d[day(421)].censored) for d in (short, whole)] == [(-1, True)] * 2

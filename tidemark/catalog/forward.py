"""Features carried forward, walk-forward folds with rule forecasters, model versions, weekly refits, data as of its date."""

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import rd, tiers
from ..operators import dependence as dep, fundamentals as fun, indicators as ind, market as mkt, panel_scores as ps, picks as pk, studies as st
from ..plans import folds as fd, grids, layers, models as md, weekly
from ..session import discard, materialised, shared_folder
from ..sources import bars as src, carried, ingest
from .ctes import CTES, W, cte, over, r, rolled, with_ctes
from . import extras, portfolios  # noqa: F401  (their fragments are used here)
from .market import D
from .registry import query
from .rules import feats
from .windows import _rsi_sql, rsel, shown

RUN = "OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING)"

# ---- the carried store -------------------------------------------------------------------------

STORE = {"ma250": "ma250", "vol_ratio": "vol_ratio", "macd_dif": "dif", "macd_signal": "sig", "macd_hist": "hist",
         "autocorr_1d": "CASE WHEN n >= 30 THEN CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END END", "up_share": "up / nullif(n, 0)::DOUBLE"}
cte("fsu", f"""SELECT p.*, count(ret) {RUN} AS n, count(*) FILTER (ret > 0) {RUN} AS up, corr(ret, before) {RUN} AS c,
  i - coalesce(max(CASE WHEN ret > 0 THEN NULL ELSE i END) {RUN}, 0) AS up_run, i - coalesce(max(CASE WHEN ret < 0 THEN NULL ELSE i END) {RUN}, 0) AS down_run
  FROM (SELECT q.code, q.dt, q.i, dif, sig, hist, ma250, vol_ratio, ret, lag(ret) OVER (PARTITION BY q.code ORDER BY q.dt) AS before FROM macdq q
    JOIN (SELECT code, dt, pct_chg AS ret, avg(close) {over(250)} AS ma250, vol / avg(vol) {over(20)} AS vol_ratio FROM panel) b ON b.code = q.code AND b.dt = q.dt) p""")


@query(with_ctes(f"SELECT code, dt, {rsel(STORE)}, up_run, down_run, i AS n_bars FROM fsu", recursive=True))
def feature_store_update(spark, base):
    """A store built on the first half of the dates and refreshed twice, with codes of few bars."""
    bars = materialised(src.instrument_bars(spark, base).select("code", "dt", "close", "vol"))  # what the recipe reads
    cal = ingest.trading_calendar(bars)
    n = cal.agg(F.max("date_idx")).scalar()
    upto = lambda share: cal.where(F.col("date_idx") <= n * share).agg(F.max("dt")).scalar()
    path, recipe = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", carried.trend_recipe()
    for share in (0.5, 0.9, 1.0):
        carried.refresh(spark, path, recipe, bars.where(F.col("dt") <= upto(share)))
    discard(bars)
    return carried.stored_features(spark, path).select("code", "dt", *[rd(c).alias(c) for c in STORE], "up_run", "down_run", "n_bars")


@query(with_ctes(f"""SELECT code, dt, i - coalesce(max(CASE WHEN pct_chg > 0 THEN NULL ELSE i END) {RUN}, 0) AS up_run,
  i - coalesce(max(CASE WHEN pct_chg < 0 THEN NULL ELSE i END) {RUN}, 0) AS down_run FROM panel"""))
def run_lengths(spark, base):
    return ind.run_lengths(src.instrument_bars(spark, base)).select("code", "dt", "up_run", "down_run")


cte("xst", f"""SELECT code, dt, pct_chg AS ret, n, s5, up, sum(CASE WHEN up <> u1 THEN 1 ELSE 0 END) {RUN} AS ch, count(*) FILTER (up) {RUN} AS ups FROM (
  SELECT *, count(pct_chg) {RUN} AS n, sum(pct_chg) {over(5)} AS s5, pct_chg > 0 AS up, lag(pct_chg > 0) {W} AS u1 FROM panel)""")


@query(with_ctes(f"SELECT code, dt, {rsel({'runs_ratio': 'CASE WHEN n >= 30 THEN (ch + 1) / (2 * ups * (n - ups) / n::DOUBLE + 1) END'})} FROM xst"))
def expanding_runs(spark, base):
    return shown(dep.expanding_statistics(src.instrument_bars(spark, base)), ["runs_ratio"])


@query(with_ctes(f"""SELECT code, dt, {rsel({'variance_ratio_5_1': 'CASE WHEN n >= 30 THEN coalesce(v5 / nullif(5 * v1, 0), 1) END',
  'gain_loss_consistency': 'CASE WHEN n >= 30 THEN coalesce(g, 0) / greatest(1, coalesce(l, 1)) END'})} FROM (
  SELECT code, dt, n, var_samp(CASE WHEN n > 5 THEN s5 END) {RUN} AS v5, var_samp(ret) {RUN} AS v1, stddev_pop(CASE WHEN ret > 0 THEN ret END) {RUN} AS g, stddev_pop(CASE WHEN ret < 0 THEN ret END) {RUN} AS l FROM xst)"""))
def expanding_variance_ratio(spark, base):
    return shown(dep.expanding_statistics(src.instrument_bars(spark, base)), ["variance_ratio_5_1", "gain_loss_consistency"])


# ---- folds and forecasters ---------------------------------------------------------------------

MARKET_PLAN = fd.FoldPlan(train0=500, val=60, step=60)
PANEL_PLAN = fd.FoldPlan(train0=1000, val=300, step=500)
CLASSES = {0: "p_reversion", 1: "p_breakout", 2: "p_momentum"}


def fold_sql(plan):
    n = f"(SELECT max(date_idx) - {plan.val + plan.gap + plan.train0} FROM calendar)"
    return f"""SELECT k AS fold, {plan.train0} + k * {plan.step} AS train_end, {plan.train0 + plan.gap + 1} + k * {plan.step} AS val_first, {plan.train0 + plan.gap + plan.val} + k * {plan.step} AS val_last
      FROM (SELECT CAST(unnest(range(0, CASE WHEN {n} < 0 THEN 0 ELSE {n} // {plan.step} + 1 END)) AS INTEGER) AS k)"""


cte("mfold", fold_sql(MARKET_PLAN))
cte("pfold", fold_sql(PANEL_PLAN))
DATES = "(SELECT dt FROM calendar WHERE date_idx = f.train_end) AS train_end_dt, (SELECT dt FROM calendar WHERE date_idx = f.val_first) AS val_first_dt, (SELECT dt FROM calendar WHERE date_idx = f.val_last) AS val_last_dt"


def counts_sql(fold, rows, more):
    """Bounds and counts of the folds of ``fold`` over ``rows`` (d, e: positions of date and label end; y: label)."""
    return f"""SELECT f.fold, {DATES}, (SELECT count(*) FROM {rows} WHERE y IS NOT NULL AND d <= f.train_end AND e < f.val_first) AS n_train, count(x.y) AS n_val, {more}
      FROM {fold} f LEFT JOIN (SELECT * FROM {rows} WHERE y IS NOT NULL) x ON x.d BETWEEN f.val_first AND f.val_last GROUP BY f.fold, f.train_end, f.val_first, f.val_last"""


BOUNDS = ["fold", "train_end_dt", "val_first_dt", "val_last_dt", "n_train", "n_val"]
cte("mkrows", f"""SELECT c.date_idx AS d, c.date_idx + 20 AS e, CASE WHEN k.f > 0 THEN 1 WHEN k.f IS NOT NULL THEN 0 END AS y, CASE WHEN k.regime_v2 IN ('bull', 'early_bull', 'rebound', 'range_up') THEN 1 ELSE 0 END AS rule
  FROM (SELECT dt, regime_v2, lead(close, 20) {D} / close - 1 AS f FROM regq3) k JOIN calendar c ON c.dt = k.dt""")


def market_data(spark, base):
    """The index with its direction, the rule's guess, and where its dates and label ends lie."""
    idx = mkt.market_index(src.l1_bars(spark, base))
    y = md.market_targets(idx).select(F.lit(mkt.MARKET).alias("code"), "dt", "fwd_dir")
    return idx, fd.placed(y, MARKET_PLAN).join(fd.market_rule(mkt.regimes(idx)), "dt")


@query(with_ctes(counts_sql("mfold", "mkrows", f"{r('avg(CASE WHEN x.rule = x.y THEN 1.0::DOUBLE ELSE 0 END)')} AS rule_accuracy, {r('avg(x.y)')} AS up_share"), recursive=True))
def market_folds(spark, base):
    idx, d = market_data(spark, base)
    d = materialised(d)
    counts = fd.fold_counts(d, idx, MARKET_PLAN, "fwd_dir")
    val = fd.validation_rows(d.where("fwd_dir is not null"), MARKET_PLAN, counts.count())
    rule = val.groupBy("fold").agg(F.avg((F.col("rule_up") == F.col("fwd_dir")).cast("int")).alias("rule_accuracy"), F.avg("fwd_dir").alias("up_share"))
    return counts.join(rule, "fold", "left").select(*BOUNDS, rd("rule_accuracy").alias("rule_accuracy"), rd("up_share").alias("up_share"))


cte("secf", f"""SELECT m.l2 AS code, f.dt, avg(g.rsi) AS rsi_14, avg(f.mom20) AS mom20, avg(f.atr_pct) AS atr_pct FROM feat f
  JOIN (SELECT code, dt, {_rsi_sql(14)} AS rsi FROM gl) g ON g.code = f.code AND g.dt = f.dt JOIN members m ON m.code = f.code GROUP BY m.l2, f.dt""")
cte("secr", """SELECT s.code, s.dt, round(list_avg(list_filter([rsi_14 / 100, (mom20 - ml) / greatest(1, mh - ml), 1 - (atr_pct - al) / greatest(1, ah - al)], lambda v: v IS NOT NULL)), 9) AS rule_score
  FROM secf s, (SELECT min(mom20) AS ml, max(mom20) AS mh, min(atr_pct) AS al, max(atr_pct) AS ah FROM secf)""")
cte("sect", """SELECT *, CASE WHEN d <= 2 OR rule_score IS NULL THEN 1 WHEN k * 3 <= n THEN 0 WHEN k * 3 <= 2 * n THEN 1 ELSE 2 END AS rule_tercile FROM (
  SELECT *, row_number() OVER (PARTITION BY dt ORDER BY rule_score NULLS LAST, code) - 1 AS k FROM secr) JOIN (SELECT dt, count(rule_score) - 1 AS n, count(DISTINCT rule_score) AS d FROM secr GROUP BY dt) USING (dt)""")


def sector_features(spark, base):
    """Means of the members' RSI, momentum and volatility per industry and date."""
    d = feats(spark, base, ind.rsi_sma(src.instrument_bars(spark, base), (14,)), ["rsi_14"])
    d = d.join(src.members(spark, base).select("code", "l2"), "code")
    return d.groupBy(F.col("l2").alias("code"), "dt").agg(*[F.avg(c).alias(c) for c in ("rsi_14", "mom20", "atr_pct", "mom5", "vol_ratio", "pos20")])


@query(with_ctes(f"SELECT code, dt, {r('rule_score', 6)} AS rule_score, CAST(rule_tercile AS INTEGER) AS rule_tercile, CASE WHEN rule_tercile = 2 THEN 1 ELSE 0 END AS rule_outperform FROM sect"))
def sector_rule_scores(spark, base):
    return fd.sector_rule(materialised(sector_features(spark, base))).withColumn("rule_score", rd("rule_score", 6))


cte("secy", "SELECT s.code, s.dt, CASE WHEN fm > med THEN 1 ELSE 0 END AS y FROM stq s JOIN (SELECT dt, median(fm) AS med FROM stq GROUP BY dt) m ON m.dt = s.dt")
cte("secrows", f"""SELECT c.date_idx AS d, e.date_idx AS e, y.y, CASE WHEN t.rule_tercile = 2 THEN 1 ELSE 0 END AS rule FROM (SELECT code, dt, lead(dt, 20) {W} AS end_dt FROM l2panel) b
  JOIN calendar c ON c.dt = b.dt JOIN sect t ON t.code = b.code AND t.dt = b.dt LEFT JOIN calendar e ON e.dt = b.end_dt LEFT JOIN secy y ON y.code = b.code AND y.dt = b.dt""")


def sector_data(spark, base):
    """Industries with features, whether they outperform, the rule's guess, and where their dates and label ends lie."""
    bars = materialised(src.l2_bars(spark, base))
    features = materialised(sector_features(spark, base))
    d = fd.placed(bars.select("code", "dt"), PANEL_PLAN).join(features, ["code", "dt"]).join(fd.sector_rule(features), ["code", "dt"])
    return bars, d.join(md.sector_targets(bars).select("code", "dt", "outperform"), ["code", "dt"], "left")


@query(with_ctes(counts_sql("pfold", "secrows", f"{r('avg(CASE WHEN x.rule = x.y THEN 1.0::DOUBLE ELSE 0 END)')} AS rule_accuracy")))
def sector_folds(spark, base):
    bars, d = sector_data(spark, base)
    d = materialised(d)
    counts = fd.fold_counts(d, bars, PANEL_PLAN, "outperform")
    val = fd.validation_rows(d.where("outperform is not null"), PANEL_PLAN, counts.count())
    rule = val.groupBy("fold").agg(F.avg((F.col("rule_outperform") == F.col("outperform")).cast("int")).alias("rule_accuracy"))
    return counts.join(rule, "fold", "left").select(*BOUNDS, rd("rule_accuracy").alias("rule_accuracy"))


METRICS = ["accuracy", "auc", "rule_accuracy", "beat"]


def market_forecasts(spark, base):
    """Out-of-sample probabilities of the fitted market model, with the regime rule's guess."""
    idx, d = market_data(spark, base)
    x = mkt.risk_features(idx, src.l2_bars(spark, base))
    cols = ["breadth_ratio", "ma20_ratio", "vol_expansion", "volume_shock", "index_deviation", "rsi_median"]
    plan = fd.FoldPlan(train0=MARKET_PLAN.train0, val=250, step=500)
    return fd.walk_forward_direction(d.join(x.select("dt", *cols), "dt"), idx, plan, cols, "fwd_dir", ["rule_up"], rounds=5)


def sector_forecasts(spark, base):
    """Out-of-sample probabilities of the fitted industry model, with the rule's guess."""
    bars, d = sector_data(spark, base)
    cols = ["rsi_14", "mom20", "atr_pct", "mom5", "vol_ratio", "pos20"]
    return fd.walk_forward_direction(d, bars, PANEL_PLAN, cols, "outperform", ["rule_outperform"], rounds=5)


def guessed(p, *columns):
    return p.select("fold", *columns, (F.col("prob") >= 0.5).cast("int").alias("predicted"))


@query()
def market_direction_model(spark, base):
    return guessed(market_forecasts(spark, base), "dt", "fwd_dir", "rule_up")


@query()
def sector_model(spark, base):
    return guessed(sector_forecasts(spark, base), "code", "dt", "outperform", "rule_outperform")


@query()
def market_walk_forward(spark, base):
    """Metrics of the market model beside the regime rule's."""
    return fd.direction_metrics(market_forecasts(spark, base), "fwd_dir", "prob", "rule_up").select("fold", "n_val", *[rd(c).alias(c) for c in METRICS])


@query()
def sector_walk_forward(spark, base):
    """Metrics of the industry model beside the rule's thirds."""
    return fd.direction_metrics(sector_forecasts(spark, base), "outperform", "prob", "rule_outperform").select("fold", "n_val", *[rd(c).alias(c) for c in METRICS])


cte("clsv", f"""SELECT f.fold, s.code, s.dt, s.fwd_ret, p_momentum, p_reversion, p_breakout, CASE WHEN fwd_ret < {md.LOSS} THEN 0 WHEN fwd_ret > {md.GAIN} THEN 2 ELSE 1 END AS y
  FROM scores s JOIN calendar c ON c.dt = s.dt JOIN pfold f ON c.date_idx BETWEEN f.val_first AND f.val_last WHERE s.fwd_ret IS NOT NULL""")
cte("clsr", "SELECT fold, k, y = k AS pos, rank() OVER (PARTITION BY fold, k ORDER BY p) + (count(*) OVER (PARTITION BY fold, k, p) - 1) / 2.0 AS rk FROM ("
    + " UNION ALL ".join(f"SELECT fold, {k} AS k, y, {p} AS p FROM clsv" for k, p in CLASSES.items()) + ")")
cte("clsa", """SELECT fold, k, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))::DOUBLE AS a
  FROM clsr GROUP BY fold, k HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0""")


def given_predictions(spark, base):
    """Given probabilities on the validation rows of all folds."""
    d = src.engine_scores(spark, base)
    n = fd.folds(d, PANEL_PLAN).count()
    d = d.join(ingest.trading_calendar(d), "dt").where("fwd_ret is not null")
    y = tiers([(F.col("fwd_ret") < md.LOSS, 0), (F.col("fwd_ret") > md.GAIN, 2)], 1)
    return fd.validation_rows(d, PANEL_PLAN, n).withColumn("y", y)


@query(with_ctes(f"""SELECT h.fold, h.n_val, {r('h.accuracy')} AS accuracy, {rsel({f'auc_{k}': f'(SELECT a FROM clsa x WHERE x.fold = h.fold AND x.k = {k})' for k in CLASSES}, 6)},
  {r('(SELECT avg(a) FROM clsa x WHERE x.fold = h.fold)', 6)} AS auc FROM (SELECT fold, count(*) AS n_val, avg(CASE WHEN g = y THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM (
  SELECT *, CASE WHEN p_reversion >= greatest(p_breakout, p_momentum) THEN 0 WHEN p_breakout >= p_momentum THEN 1 ELSE 2 END AS g FROM clsv) GROUP BY fold) h"""))
def fold_class_metrics(spark, base):
    d = fd.class_metrics(given_predictions(spark, base), CLASSES, "y")
    return d.select("fold", "n_val", rd("accuracy").alias("accuracy"), *[rd(c, 6).alias(c) for c in (*[f"auc_{k}" for k in CLASSES], "auc")])


@query(with_ctes(f"""SELECT fold, n AS n_rows, {rsel({'top_median': 'CASE WHEN n >= 20 THEN t ELSE 0 END', 'bottom_median': 'CASE WHEN n >= 20 THEN b ELSE 0 END', 'spread': 'CASE WHEN n >= 20 THEN t - b ELSE 0 END'})} FROM (
  SELECT fold, count(*) AS n, median(fwd_ret) FILTER (hi <= 20) AS t, median(fwd_ret) FILTER (lo <= 20) AS b FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p_momentum DESC, dt, code) AS hi,
  row_number() OVER (PARTITION BY fold ORDER BY p_momentum, dt, code) AS lo FROM clsv) GROUP BY fold)"""))
def fold_spread(spark, base):
    d = fd.median_spread(given_predictions(spark, base), "p_momentum", "fwd_ret")
    return d.select("fold", "n_rows", *[rd(c).alias(c) for c in ("top_median", "bottom_median", "spread")])


# ---- model versions and layers -----------------------------------------------------------------

DAYS = "datediff('day', DATE '1995-01-01', dt)"
cte("lay0", "SELECT max(date_idx) // 2 AS half FROM calendar")
cte("lay1", """SELECT c.dt, CAST((c.date_idx - f.first) // 5 AS INTEGER) AS version, v.dt AS asof_dt FROM calendar c, (SELECT greatest(half, 2) AS first FROM lay0) f
  JOIN calendar v ON v.date_idx = f.first - 1 + ((c.date_idx - f.first) // 5) * 5 WHERE c.date_idx >= f.first""")
cte("laym", f"SELECT dt, (({DAYS} * 7919 + version * 104729) % 1000) / 1000.0::DOUBLE AS up_prob FROM lay1")
cte("lays", f"""SELECT *, row_number() OVER (PARTITION BY dt ORDER BY prob DESC, sector) AS sector_rank FROM (
  SELECT DISTINCT b.dt, b.code AS sector, ((b.code * 6007 + {DAYS.replace('dt)', 'b.dt)')} * 15487 + version * 131) % 1000) / 1000.0::DOUBLE AS prob FROM l2bars b JOIN lay1 v ON v.dt = b.dt)""")
cte("layp", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY win_prob DESC, code) AS rk FROM (
  SELECT s.dt, s.code, i.l2 AS sector, CASE WHEN up_prob > 0.6 THEN 'bull' WHEN up_prob < 0.4 THEN 'bear' ELSE 'range' END AS regime, up_prob, b.sector_rank,
    CASE WHEN up_prob > 0.6 THEN p_momentum WHEN up_prob < 0.4 THEN p_breakout ELSE p_reversion END AS win_prob, t1_ret, d5_ret
  FROM scores s JOIN members i ON i.code = s.code JOIN laym k ON k.dt = s.dt JOIN lays b ON b.dt = s.dt AND b.sector = i.l2 AND b.sector_rank <= 5) WHERE win_prob >= 0.55) WHERE rk <= 10""")


def versions(spark, base):
    days = src.trade_ticks(spark, base).select("dt").distinct()
    cal = ingest.trading_calendar(days)
    half = F.floor(cal.agg(F.max("date_idx")).scalar() / 2)
    since = cal.where(F.col("date_idx") == half).agg(F.max("dt")).scalar()
    return layers.newest_version(days, layers.version_dates(days, since))


@query(with_ctes("SELECT dt, version, asof_dt FROM lay1"))
def model_versions(spark, base):
    return versions(spark, base)


def layered(spark, base):
    """Picks from given scores that depend on the version that may score a date."""
    v = materialised(versions(spark, base))
    n = F.datediff("dt", F.lit("1995-01-01").cast("date")).cast("long")
    market = v.select("dt", (((n * 7919 + F.col("version") * 104729) % 1000) / 1000.0).alias("up_prob"))
    sectors = src.l2_bars(spark, base).select(F.col("code").alias("sector"), "dt").join(v, "dt")
    sectors = sectors.select("dt", "sector", (((F.col("sector") * 6007 + n * 15487 + F.col("version") * 131) % 1000) / 1000.0).alias("prob"))
    rows = src.engine_scores(spark, base).join(src.members(spark, base).select("code", F.col("l2").alias("sector")), "code").join(v.select("dt"), "dt", "left_semi")
    return layers.layered_picks(market, sectors, rows.select("dt", "code", "sector", "p_momentum", "p_reversion", "p_breakout", "t1_ret", "d5_ret"))


@query(with_ctes(f"SELECT dt, code, sector, regime, {r('up_prob')} AS up_prob, CAST(sector_rank AS INTEGER) AS sector_rank, {r('win_prob')} AS win_prob, CAST(rk AS INTEGER) AS rank, {rsel({'t1_ret': 't1_ret', 'd5_ret': 'd5_ret'})} FROM layp"))
def layered_picks(spark, base):
    d = layered(spark, base)
    return d.select("dt", "code", "sector", "regime", rd("up_prob").alias("up_prob"), "sector_rank", rd("win_prob").alias("win_prob"), "rank", rd("t1_ret").alias("t1_ret"), rd("d5_ret").alias("d5_ret"))


@query(with_ctes(f"""SELECT regime, count(DISTINCT dt) AS n_days, count(*) AS n_picks, {rsel({x: e for c in ('t1_ret', 'd5_ret') for x, e in ((f'{c}_win_rate', f'count(*) FILTER ({c} > 0) / nullif(count({c}), 0)::DOUBLE'), (f'{c}_mean', f'avg({c})'))})} FROM layp GROUP BY regime"""))
def layered_summary(spark, base):
    d = layers.layer_summary(layered(spark, base), ["t1_ret", "d5_ret"])
    return d.select("regime", "n_days", "n_picks", *[rd(f"{c}_{k}").alias(f"{c}_{k}") for c in ("t1_ret", "d5_ret") for k in ("win_rate", "mean")])


# ---- weekly refits -----------------------------------------------------------------------------

cte("wkw", """SELECT week, week - 84 AS train_start, week - 1 AS train_end, val_start, val_end FROM (
  SELECT CAST(date_trunc('week', dt) AS DATE) AS week, min(dt) AS val_start, max(dt) AS val_end FROM calendar GROUP BY 1) WHERE week - 84 >= (SELECT CAST(date_trunc('week', min(dt)) AS DATE) FROM calendar)""")
cte("wkr", f"SELECT code, dt, p_momentum, d5_ret, lead(dt, 5) {W} AS end_dt, CAST(date_trunc('week', dt) AS DATE) AS week FROM scores")
cte("wkt", "SELECT w.week, count(*) AS n FROM wkw w JOIN wkr x ON x.dt >= w.train_start AND x.dt < w.week AND x.end_dt < w.week AND x.d5_ret IS NOT NULL GROUP BY w.week")


def weekly_rows(spark, base):
    d = materialised(weekly.with_outcome_date(src.engine_scores(spark, base), 5).select("code", "dt", "end_dt", "p_momentum", "d5_ret"))
    return d, materialised(weekly.weekly_windows(d))  # a row per week, which the planner then knows


@query(with_ctes("""SELECT CAST(week AS DATE) AS week, CAST(train_start AS DATE) AS train_start, CAST(train_end AS DATE) AS train_end, val_start, val_end, coalesce(t.n, 0) AS n_train, coalesce(v.n, 0) AS n_val FROM wkw
  LEFT JOIN wkt t USING (week) LEFT JOIN (SELECT week, count(*) AS n FROM wkr WHERE d5_ret IS NOT NULL GROUP BY week) v USING (week)"""))
def weekly_windows(spark, base):
    d, windows = weekly_rows(spark, base)
    return weekly.window_counts(d, windows, "d5_ret")


def _week_ic(pred):
    rk = lambda x: f"rank() OVER (PARTITION BY week ORDER BY {x}) + (count(*) OVER (PARTITION BY week, {x}) - 1) / 2.0"
    return f"""SELECT week, n, ic FROM (SELECT week, count(*) AS n, corr(a, b) AS ic FROM (SELECT week, {rk('p')} AS a, {rk('d5_ret')} AS b FROM (SELECT week, d5_ret, {pred} AS p FROM wkr JOIN wkw USING (week) WHERE d5_ret IS NOT NULL)) GROUP BY week)
      WHERE n >= 10 AND ic IS NOT NULL AND NOT isnan(ic)"""


@query(with_ctes(f"""SELECT p.week, p.n, {r('p.ic', 6)} AS ic_plain, {r('b.ic', 6)} AS ic_boosted, {r('w.s')} AS win_rate FROM ({_week_ic('p_momentum')}) p LEFT JOIN ({_week_ic('CASE WHEN d5_ret > 2 THEN p_momentum * 2 ELSE p_momentum END')}) b ON b.week = p.week
  LEFT JOIN (SELECT x.week, count(*) FILTER (d5_ret > 0) / count(*)::DOUBLE AS s FROM wkr x JOIN (SELECT week, round(avg(p_momentum), 9) AS m FROM wkr WHERE d5_ret IS NOT NULL GROUP BY week) m ON m.week = x.week WHERE d5_ret IS NOT NULL AND p_momentum > m GROUP BY x.week) w ON w.week = p.week"""))
def weekly_rank_ic(spark, base):
    d, windows = weekly_rows(spark, base)
    p = weekly.validation_rows(d, windows)
    d = weekly.weekly_ic(p, "p_momentum", "d5_ret")
    return d.select("week", "n", rd("ic_plain", 6).alias("ic_plain"), rd("ic_boosted", 6).alias("ic_boosted"), rd("win_rate").alias("win_rate"))


@query(with_ctes(f"""SELECT week, count(*) AS n_rows, {r('regr_slope(d5_ret, p_momentum)', 3)} AS weight, {r('regr_intercept(d5_ret, p_momentum)', 3)} AS intercept
  FROM (SELECT w.week, x.p_momentum, x.d5_ret FROM wkw w JOIN wkr x ON x.dt >= w.train_start AND x.dt < w.week AND x.end_dt < w.week AND x.d5_ret IS NOT NULL) GROUP BY week HAVING count(*) >= 100"""))
def weekly_refit(spark, base):
    """The fit of every week on one column without a penalty, which is the least-squares line."""
    d, windows = weekly_rows(spark, base)
    fits = weekly.weekly_ridge(weekly.window_rows(d, windows), ["p_momentum"], "d5_ret", penalty=0.0)
    return fits.select("week", "n_rows", rd(F.col("weights")[0], 3).alias("weight"), rd("intercept", 3).alias("intercept"))


# ---- data as of its date -----------------------------------------------------------------------

VALUES = ["pe_ttm", "pb", "roe", "gross_margin", "total_mv"]
EXT = {**{c: f"v.{c}" for c in VALUES}, "earnings_yield": "CASE WHEN v.pe_ttm > 1e-10 THEN 1 / v.pe_ttm WHEN v.pe_ttm IS NOT NULL THEN 0 END",
       "net_profit_margin": "n_income / nullif(revenue, 0)", "cfo_margin": "cfo / nullif(revenue, 0)", "fcf_margin": "fcf / nullif(revenue, 0)", "capex_intensity": "capex / nullif(revenue, 0)",
       "cash_conversion": "(cfo - capex) / nullif(n_income, 0)", "revenue_growth": "(revenue / nullif(rev_before, 0) - 1) * 100"}


@query(with_ctes(f"""SELECT p.code, p.dt, v.dt AS valuation_dt, s.known AS statement_dt, {rsel(EXT)}, CAST(datediff('day', s.end_date, p.dt) AS INTEGER) AS statement_age FROM panel p ASOF LEFT JOIN valuation v ON v.code = p.code AND p.dt >= v.dt
  ASOF LEFT JOIN (SELECT *, end_date + 120 AS known, lag(revenue) OVER (PARTITION BY code ORDER BY end_date) AS rev_before FROM statements) s ON s.code = p.code AND p.dt >= s.known"""))
def external_features(spark, base):
    d = fun.external_features(src.instrument_bars(spark, base).select("code", "dt"), src.valuation(spark, base), src.statements(spark, base))
    return d.select("code", "dt", "valuation_dt", "statement_dt", *[rd(c).alias(c) for c in EXT], "statement_age")


# ---- grids of weightings -----------------------------------------------------------------------

FOUR = ["momentum_score", "slope_score", "turnover_score", "strength_score"]
SIX = [*FOUR, "breadth_score", "mf_score"]
NINE = [*SIX, "proximity_score", "stability_score", "vol_change_score"]
LOOKBACKS, TOPS = (10, 15, 20, 30, 60), (1, 2, 3)
GRID_WEIGHTS = grids.four_factor_weights((0.20, 0.25, 0.30, 0.35, 0.40), (0.15, 0.20, 0.25, 0.30, 0.35))
SIX_WEIGHTS = grids.simplex(6, 5, least=2)


def panel_ctes(k):
    """The score panel of the regions with another lookback."""
    again = lambda name: CTES[name].replace("l2panel", "l1panel").replace(over(20), over(k)).replace("lag(close, 20)", f"lag(close, {k})")
    cte(f"r0_{k}", again("pp0"))
    cte(f"r1_{k}", again("pp1").replace("FROM pp0", f"FROM r0_{k}"))
    cte(f"rq_{k}", again("ppq").replace("FROM pp1", f"FROM r1_{k}"))


for _k in LOOKBACKS:
    panel_ctes(_k)


def weights_cte(name, factors, weights):
    cte(name, f"SELECT * FROM (VALUES {', '.join(f'({i}, ' + ', '.join(f'{x!r}::DOUBLE' for x in w) + ')' for i, w in enumerate(weights))}) AS t(combo, {', '.join(f'w_{f}' for f in factors)})")


def mixed_sql(factors):
    return f"round({' + '.join(f'w_{f} * {f}' for f in factors)}, 9)"


weights_cte("w4", FOUR, GRID_WEIGHTS)
weights_cte("w6", SIX, SIX_WEIGHTS)
weights_cte("w9", NINE, [tuple(float(i == j) for j in range(9)) for i in range(9)])
for _level, _panel in (("l1", "rq_20"), ("l2", "ppq")):
    cte(f"mem_{_level}", f"""SELECT b.dt, b.{_level} AS code, CASE WHEN n >= 3 THEN s * 10 ELSE 5 END AS breadth_score, coalesce((tanh(f / 1e5) + 1) * 5, 5) AS mf_score FROM (SELECT dt, {_level}, count(*) AS n, avg(CASE WHEN close > m THEN 1.0::DOUBLE ELSE 0 END) AS s FROM (
      SELECT code, dt, close, {rolled('avg', 'close', 20, 20)} AS m FROM panel) JOIN members USING (code) GROUP BY dt, {_level}) b LEFT JOIN (SELECT dt, {_level}, sum(net_mf_amount) AS f FROM moneyflow JOIN members USING (code) GROUP BY dt, {_level}) x ON x.dt = b.dt AND x.{_level} = b.{_level}""")
    cte(f"fac_{_level}", f"SELECT p.*, m.breadth_score, m.mf_score FROM {_panel} p JOIN mem_{_level} m ON m.dt = p.dt AND m.code = p.code WHERE p.fwd IS NOT NULL")


def separation_sql(rows, weights, factors, regimes):
    ranked = f"""SELECT combo, kind, fwd, (rank() OVER (PARTITION BY combo, dt ORDER BY s DESC) + (count(*) OVER (PARTITION BY combo, dt, s) - 1) / 2.0) / count(*) OVER (PARTITION BY combo, dt) AS rk
      FROM (SELECT w.combo, p.dt, p.fwd, {'u.regime' if regimes else 'NULL'} AS kind, {mixed_sql(factors)} AS s FROM {rows} p {'LEFT JOIN upreg u ON u.dt = p.dt' if regimes else ''} JOIN {weights} w ON true)"""
    kinds = "unnest(list_distinct(['ALL', coalesce(kind, 'ALL')]))" if regimes else "'ALL'"
    return f"""SELECT regime, CAST(combo AS INTEGER) AS combo, n_top, n_bottom, {rsel({c: f'CASE WHEN n_top >= 20 AND n_bottom >= 20 THEN {e} END' for c, e in {'top_avg': 't', 'bottom_avg': 'b', 'separation': 't - b', 'top_win': 'w'}.items()}, 3)} FROM (
      SELECT regime, combo, count(*) FILTER (rk <= 0.25) AS n_top, count(*) FILTER (rk >= 0.75) AS n_bottom, avg(fwd) FILTER (rk <= 0.25) AS t, avg(fwd) FILTER (rk >= 0.75) AS b, count(*) FILTER (rk <= 0.25 AND fwd > 0) * 100.0 / nullif(count(*) FILTER (rk <= 0.25), 0) AS w
      FROM (SELECT {kinds} AS regime, * FROM ({ranked})) GROUP BY regime, combo)"""


def factor_panel(spark, base, level):
    """Score panel of an industry level with breadth and money flow of its members."""
    bars = (src.l1_bars if level == "l1" else src.l2_bars)(spark, base)
    members = src.members(spark, base).select("code", F.col(level).alias("industry"))
    more = ps.member_scores(src.instrument_bars(spark, base), src.moneyflow(spark, base), members, scale=1e5).withColumnRenamed("industry", "code")
    return materialised(ps.persistence_panel(bars).join(more, ["dt", "code"]))


SEPARATION = ["top_avg", "bottom_avg", "separation", "top_win"]


def shown_separation(d):
    return d.select("regime", "combo", "n_top", "n_bottom", *[rd(c, 3).alias(c) for c in SEPARATION])


@query(with_ctes(separation_sql("fac_l2", "w9", NINE, False)))
def single_factor_separation(spark, base):
    """What each of the nine factors separates alone."""
    return shown_separation(grids.weight_separation(factor_panel(spark, base, "l2"), NINE, [tuple(float(i == j) for j in range(9)) for i in range(9)]))


@query(with_ctes(separation_sql("fac_l1", "w6", SIX, True), recursive=True))
def weight_grid(spark, base):
    """All weightings of six factors in fifths with two or more in use, over all dates and by regime."""
    regimes = mkt.up_ema_regimes(mkt.market_index(src.l1_bars(spark, base))).select("dt", "regime")
    return shown_separation(grids.weight_separation(factor_panel(spark, base, "l1").join(regimes, "dt", "left"), SIX, SIX_WEIGHTS, regime="regime"))


_pg = " UNION ALL ".join(f"SELECT {k} AS lookback, w.combo, p.code, p.dt, x.nr, {mixed_sql(FOUR)} AS s FROM rq_{k} p JOIN pgret x ON x.code = p.code AND x.dt = p.dt JOIN w4 w ON true WHERE x.nr IS NOT NULL" for k in LOOKBACKS)
cte("pgret", f"SELECT code, dt, lead(close) {W} / close - 1 AS nr FROM l1panel")
cte("pgday", f"""SELECT lookback, combo, t."top", dt, avg(nr) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY lookback, combo, dt ORDER BY s DESC, code) AS k FROM ({_pg})) JOIN (SELECT unnest([1, 2, 3]) AS "top") t ON k <= t."top" GROUP BY ALL""")
cte("pgnav", """SELECT *, exp(s - greatest(max(s) OVER (PARTITION BY lookback, combo, "top" ORDER BY dt), 0)) - 1 AS dd FROM (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY lookback, combo, "top" ORDER BY dt) AS s FROM pgday)""")


@query(with_ctes(f"""SELECT CAST(lookback AS INTEGER) AS lookback, CAST(combo AS INTEGER) AS combo, CAST("top" AS INTEGER) AS "top", count(*) AS n_days, {r('arg_max(s, dt)', 3)} AS log_return, {r('min(dd)')} AS max_drawdown,
  {r('(avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252)')} AS sharpe, min(dd) > -0.35 AS eligible FROM pgnav GROUP BY lookback, combo, "top" """))
def portfolio_weight_grid(spark, base):
    """375 portfolios: five lookbacks, twenty-five weightings, three sizes."""
    bars = materialised(src.l1_bars(spark, base))
    after = bars.select("code", "dt", (F.lead("close").over(ind.series()) / F.col("close") - 1).alias("next_ret"))
    panels = {k: ps.persistence_panel(bars, lookback=k).join(after, ["code", "dt"]) for k in LOOKBACKS}
    d = grids.portfolio_grid(panels, FOUR, GRID_WEIGHTS, TOPS)
    return d.select("lookback", "combo", "top", "n_days", rd("log_return", 3).alias("log_return"), rd("max_drawdown").alias("max_drawdown"), rd("sharpe").alias("sharpe"), "eligible")


# ---- one study over the daily picks ------------------------------------------------------------

PICK_FACTORS = {"momentum_5d": "m5", "momentum_20d": "m20", "volatility_20d": "v20", "volume_ratio": "vr", "ma20_deviation": "dev", "atr_ratio": "atr_ratio", "score": "score"}
POINTS = (5, 25, 50, 75, 95)
cte("pkst", " UNION ALL ".join(f"SELECT '{k}' AS factor, {c} AS x, fwd FROM dayp WHERE fwd IS NOT NULL AND {c} IS NOT NULL" for k, c in PICK_FACTORS.items()))
cte("pkqb", """SELECT p.factor, CAST(CASE WHEN x > q1 THEN 1 ELSE 0 END + CASE WHEN x > q2 THEN 1 ELSE 0 END + CASE WHEN x > q3 THEN 1 ELSE 0 END AS INTEGER) AS bucket, fwd
  FROM pkst p JOIN (SELECT factor, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM pkst GROUP BY factor) q ON q.factor = p.factor""")


def picks(spark, base):
    bars = materialised(src.instrument_bars(spark, base).select("code", "dt", "high", "low", "close", "vol"))  # picks read them twice
    return materialised(pk.day_picks(pk.day_factors(bars)))


@query(with_ctes(f"""SELECT factor, bucket, n, {rsel({'avg_return': 'a', 'win_rate': 'w', 'spread': 'max(CASE WHEN bucket = 3 THEN a END) OVER (PARTITION BY factor) - max(CASE WHEN bucket = 0 THEN a END) OVER (PARTITION BY factor)'}, 3)}
  FROM (SELECT factor, bucket, count(*) AS n, avg(fwd) AS a, count(*) FILTER (fwd > 0) * 100.0 / count(*) AS w FROM pkqb GROUP BY factor, bucket)"""))
def pick_factor_quartiles(spark, base):
    d = st.factor_quantiles(picks(spark, base), list(PICK_FACTORS), "forward_return")
    return d.select("factor", "bucket", "n", *[rd(c, 3).alias(c) for c in ("avg_return", "win_rate", "spread")])


@query(with_ctes(f"""SELECT CAST(rk AS INTEGER) AS rk, count(*) AS n, {rsel({'avg_return': 'avg(fwd)', 'median_return': 'median(fwd)', 'win_gt0': 'count(*) FILTER (fwd > 0) * 100.0 / count(*)', 'win_gt5': 'count(*) FILTER (fwd > 5) * 100.0 / count(*)',
  'win_gt10': 'count(*) FILTER (fwd > 10) * 100.0 / count(*)', **{f'p{p}': f'quantile_cont(fwd, {p / 100})' for p in POINTS}}, 3)} FROM dayp WHERE fwd IS NOT NULL GROUP BY rk"""))
def pick_rank_study(spark, base):
    """Outcomes by the place of a pick on its day, with percentiles."""
    d = picks(spark, base).where("forward_return is not null")
    stats = st.outcome_stats(d, ["rk"], "forward_return").join(st.percentile_panel(d, "forward_return", ["rk"], POINTS), "rk")
    return stats.select("rk", "n", *[rd(c, 3).alias(c) for c in ("avg_return", "median_return", "win_gt0", "win_gt5", "win_gt10", *[f"p{p}" for p in POINTS])])

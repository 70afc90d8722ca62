"""Pullbacks, persistence panel, targets, models, set operations and scalar functions."""

from pyspark.sql import functions as F

from ..functions.scalar import clip, corr, nz, rd
from ..operators import indicators as ind, market as mkt, panel_scores as ps, pullbacks as pb, studies as st
from ..plans import models as md
from ..session import discard, materialised
from ..sources import bars as src
from ..sources import ingest
from ..sources.tables import table
from .ctes import W, cte, over, r, rolled, with_ctes
from .market import D
from .registry import query
from .rules import feats, folds
from .windows import rsel, shown

cte("pbc", f"""SELECT code, dt, close, i - 1 AS i, n, coalesce((close / pre_close - 1) * 100, 0) <= -3 OR coalesce((close / lag(close, 3) {W} - 1) * 100 <= -5, false) OR (close / max(close) OVER (PARTITION BY code ORDER BY dt) - 1) * 100 <= -5 AS h FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM l1panel)""")
cte("pbh", "SELECT code, dt, close, i FROM pbc WHERE h AND i >= 20 AND i < n - 1 AND n >= 60")
cte("pbe", """SELECT code, min(i) AS i FROM pbh GROUP BY code UNION ALL SELECT r.code, (SELECT min(c.i) FROM pbh c WHERE c.code = r.code AND c.i >= r.i + 15) AS i FROM pbe r WHERE (SELECT min(c.i) FROM pbh c WHERE c.code = r.code AND c.i >= r.i + 15) IS NOT NULL""")
cte("pbl", """SELECT e.code, e.i AS e, h.dt AS event_dt, h.close AS entry, min(p.close) AS nadir, arg_min(p.i, {'c': p.close, 'i': p.i}) AS ni FROM pbe e JOIN pbh h ON h.code = e.code AND h.i = e.i JOIN pbc p ON p.code = e.code AND p.i BETWEEN e.i AND e.i + 29 GROUP BY ALL""")
cte("pbev", """SELECT l.*, coalesce((SELECT min(p.i) FROM pbc p WHERE p.code = l.code AND p.i BETWEEN l.ni AND l.ni + 249 AND p.close >= l.entry) - l.ni, -1) AS rec FROM pbl l""")


@query(with_ctes(f"SELECT code, event_dt, {rsel({'entry': 'entry', 'nadir': 'nadir', 'max_drawdown_pct': '(nadir / entry - 1) * 100'})}, CAST(ni - e AS INTEGER) AS duration, CAST(rec AS INTEGER) AS recovery_days FROM pbev", recursive=True))
def pullback_events(spark, base):
    d = pb.pullback_events(src.l1_bars(spark, base))
    return d.select("code", "event_dt", *[rd(c).alias(c) for c in ("entry", "nadir", "max_drawdown_pct")], "duration", "recovery_days")


@query(with_ctes("""SELECT code, event_dt, CAST(coalesce(rec, -1) AS INTEGER) AS recovery_days, rec IS NULL AS censored FROM (SELECT l.code, l.event_dt, l.entry, l.ni, min(p.i) - l.ni AS rec FROM pbl l LEFT JOIN pbc p ON p.code = l.code AND p.i >= l.ni AND p.close >= l.entry
  GROUP BY l.code, l.event_dt, l.entry, l.ni)""", recursive=True))
def pullback_recovery(spark, base):
    """Recoveries however late; those that have not come by the last bar are censored."""
    return pb.pullback_events(src.l1_bars(spark, base), recovery_span=None).select("code", "event_dt", "recovery_days", "censored")


@query(with_ctes(f"""SELECT code, count(*) AS n_events, count(*) FILTER (rec >= 0) AS recovered_count, {rsel({'recovery_rate': 'count(*) FILTER (rec >= 0) * 100.0 / count(*)', 'mean_recovery_days': 'avg(rec) FILTER (rec >= 0)'})}, CAST(min(rec) FILTER (rec >= 0) AS INTEGER) AS best_case_days, CAST(max(rec) FILTER (rec >= 0) AS INTEGER) AS worst_case_days FROM pbev GROUP BY code""", recursive=True))
def pattern_statistics(spark, base):
    d = st.pattern_statistics(pb.pullback_events(src.l1_bars(spark, base)), ["code"])
    return d.select("code", "n_events", "recovered_count", rd("recovery_rate").alias("recovery_rate"), rd("mean_recovery_days").alias("mean_recovery_days"), "best_case_days", "worst_case_days")


@query(with_ctes(f"SELECT CAST(day AS INTEGER) AS day, {r('count(*) FILTER (rec <= day) * 100.0 / count(*)')} AS win_rate FROM (SELECT rec FROM pbev WHERE rec >= 0) JOIN (SELECT unnest(range(1, 1 + (SELECT max(rec) FROM pbev))) AS day) ON true GROUP BY day", recursive=True))
def recovery_curve(spark, base):
    d = st.recovery_curve(pb.pullback_events(src.l1_bars(spark, base)))
    return d.select("day", rd("win_rate").alias("win_rate"))


@query()
def recovery_confidence(spark, base):
    bars = src.week_bars(spark, base)
    d = pb.recovery_confidence(bars, pb.pullback_events(bars))
    return d.select("code", "dt", rd("rsi").alias("rsi"), rd("drawdown").alias("drawdown"), "n_events", "confidence", "verdict", "adjusted_days")


cte("mgx", f"""SELECT *, count(*) FILTER (c1 < -0.5) OVER (PARTITION BY code ORDER BY dt ROWS 2 PRECEDING) >= 3 AS rn, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM (SELECT code, dt, round((rzye - lag(rzye) {W}) / nullif(abs(lag(rzye) {W}), 0) * 100, 9) AS c1, round((rzye - lag(rzye, 3) {W}) / nullif(abs(lag(rzye, 3) {W}), 0) * 100, 9) AS c3 FROM margin)""")


@query(with_ctes(f"""SELECT code, dt, {r('c3', 3)} AS chg_3d, {r('coalesce(p, 50)', 3)} AS percentile, coalesce(p <= 10, false) OR rn AS detected FROM (
  SELECT code, max(dt) AS dt, arg_max(rn, dt) AS rn, max(last_c3) AS c3, count(*) FILTER (c3 <= last_c3) * 100.0::DOUBLE / nullif(count(c3), 0) AS p FROM (
  SELECT *, max(CASE WHEN k = 1 THEN c3 END) OVER (PARTITION BY code) AS last_c3 FROM mgx) GROUP BY code)"""))
def margin_extreme(spark, base):
    d = pb.margin_extreme(src.margin(spark, base))
    return d.select("code", "dt", rd("chg_3d", 3).alias("chg_3d"), rd("percentile", 3).alias("percentile"), "detected")


cte("pkq", f"""SELECT *, CASE WHEN i > 5 AND count(close) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AND close > max(close) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND close > max(close) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) THEN i END AS pi FROM macdq""")


@query(with_ctes(f"""SELECT q.code, q.dt, q.i >= 60 AND coalesce(len(q.l) >= 2 AND a.close > b.close AND a.dif <= b.dif, false) AS peak_divergence FROM (SELECT *, list(pi) FILTER (pi IS NOT NULL) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 54 PRECEDING AND 5 PRECEDING) AS l FROM pkq) q
  LEFT JOIN macdq a ON a.code = q.code AND a.i = q.l[-1] LEFT JOIN macdq b ON b.code = q.code AND b.i = q.l[-2]""", recursive=True))
def macd_peak_divergence(spark, base):
    return pb.peak_divergence(ind.macd(src.instrument_bars(spark, base))).select("code", "dt", "peak_divergence")


SC = ("momentum_score", "slope_score", "turnover_score", "strength_score", "proximity_score", "stability_score", "vol_change_score", "score")
cte("pp0", f"""SELECT *, avg(close) {over(20)} AS m, stddev_samp(close) {over(20)} AS s, (close / lag(close, 20) {W} - 1) * 100 AS mom20, regr_slope(close, i) {over(20)} AS b, corr(close, i) {over(20)} AS c, vol / avg(vol) {over(20)} AS t, close / max(close) {over(252)} AS h,
  coalesce(stddev_pop(ret) {over(20)} / nullif(stddev_pop(ret) {over(60)}, 0), 1) AS v, count(ret) {over(60)} AS n60, (lead(close, 5) {W} / close - 1) * 100 AS fwd FROM (SELECT *, close / pre_close - 1 AS ret FROM l2panel)""")
cte("pp1", """SELECT code, dt, mom20, fwd, coalesce(least(greatest((close - m + 2 * s) / nullif(4 * s, 0), 0), 1), 0.5) * 4 + least(greatest((mom20 + 20) / 4, 0), 10) * 0.6 AS momentum_score, least(greatest(b / (close * 0.005) + 5, 0), 10) AS slope_score,
  least(greatest(CASE WHEN t < 0.5 THEN 2 WHEN t < 1 THEN 5 + (t - 0.5) * 10 WHEN t < 1.5 THEN 10 - (t - 1) * 4 WHEN t < 3 THEN 8 - (t - 1.5) * 2 ELSE greatest(0, 5 - (t - 3) * 2) END, 0), 10) AS turnover_score, least(greatest((h - 0.5) * 20, 0), 10) AS proximity_score, coalesce(c * c, 0) * 10 AS stability_score,
  CASE WHEN n60 >= 60 THEN least(greatest(CASE WHEN v < 0.5 THEN 3 WHEN v < 1 THEN 5 + (v - 0.5) * 8 WHEN v < 1.5 THEN 9 - (v - 1) * 4 WHEN v < 2.5 THEN 7 - (v - 1.5) * 3 ELSE greatest(1, 4 - (v - 2.5) * 2) END, 0), 10) ELSE 5 END AS vol_change_score FROM pp0 WHERE mom20 IS NOT NULL""")
cte("ppq", "SELECT *, momentum_score * 0.3 + slope_score * 0.25 + turnover_score * 0.2 + strength_score * 0.25 AS score FROM (SELECT *, least(greatest(slope_score / (avg(slope_score) OVER (PARTITION BY dt) + 0.01) * 5, 0), 10) AS strength_score FROM pp1)")


@query(with_ctes(f"SELECT code, dt, {rsel({k: k for k in SC}, 3)}, {r('fwd', 3)} AS forward_return FROM ppq"))
def persistence_panel(spark, base):
    return shown(ps.persistence_panel(src.l2_bars(spark, base)), [*SC, "forward_return"], 3)


@query(with_ctes(f"""SELECT b.dt, b.l2 AS industry, {r('CASE WHEN n >= 3 THEN s * 10 ELSE 5 END')} AS breadth_score, {r('coalesce((tanh(f / 1e5) + 1) * 5, 5)')} AS mf_score FROM (SELECT dt, l2, count(*) AS n, avg(CASE WHEN close > m THEN 1.0::DOUBLE ELSE 0 END) AS s FROM (SELECT code, dt, close, {rolled('avg', 'close', 20, 20)} AS m FROM panel) JOIN members USING (code) GROUP BY dt, l2) b
  LEFT JOIN (SELECT dt, l2, sum(net_mf_amount) AS f FROM moneyflow JOIN members USING (code) GROUP BY dt, l2) x ON x.dt = b.dt AND x.l2 = b.l2"""))
def industry_member_scores(spark, base):
    d = ps.member_scores(src.instrument_bars(spark, base), src.moneyflow(spark, base), src.members(spark, base).withColumnRenamed("l2", "industry"), scale=1e5)
    return shown(d, ["breadth_score", "mf_score"], keys=("dt", "industry"))


GRID = [(h, m) for h in (6.0, 6.5, 7.0, 7.5) for m in (3.0, 4.0, 5.0)]


@query(with_ctes(f"""SELECT h AS high, m AS medium, count(*) FILTER (score >= h) AS n_high, count(*) FILTER (score < m) AS n_low, {r('avg(fwd) FILTER (score >= h) - avg(fwd) FILTER (score < m)', 3)} AS separation FROM ppq JOIN (SELECT unnest([{', '.join(f"{{'h': {h}::DOUBLE, 'm': {m}::DOUBLE}}" for h, m in GRID)}]) AS g) ON true, LATERAL (SELECT g.h AS h, g.m AS m) WHERE fwd IS NOT NULL GROUP BY h, m"""))
def threshold_grid(spark, base):
    d = ps.persistence_panel(src.l2_bars(spark, base)).where("forward_return is not null")
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("high"), F.lit(m).alias("medium")) for h, m in GRID]))
    d = d.select("score", "forward_return", grid.alias("_g")).select("score", "forward_return", "_g.high", "_g.medium")
    hi, lo = F.col("score") >= F.col("high"), F.col("score") < F.col("medium")
    agg = d.groupBy("high", "medium").agg(F.sum(st.one_if(hi)).alias("n_high"), F.sum(st.one_if(lo)).alias("n_low"), (F.avg(F.when(hi, F.col("forward_return"))) - F.avg(F.when(lo, F.col("forward_return")))).alias("separation"))
    return agg.withColumn("separation", rd("separation", 3))


cte("stq", f"SELECT code, dt, fm FROM (SELECT code, dt, CASE WHEN count(pct_chg) OVER f >= 20 THEN avg(pct_chg) OVER f END AS fm FROM l2panel WINDOW f AS (PARTITION BY code ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) WHERE fm IS NOT NULL")


@query(with_ctes(f"SELECT s.code, s.dt, {r('fm')} AS fwd_mean, CASE WHEN fm <= q1 THEN 0 WHEN fm <= q2 THEN 1 ELSE 2 END AS tercile, CASE WHEN fm > med THEN 1 ELSE 0 END AS outperform FROM stq s JOIN (SELECT dt, quantile_cont(fm, 1 / 3.0) AS q1, quantile_cont(fm, 2 / 3.0) AS q2, median(fm) AS med FROM stq GROUP BY dt) USING (dt)"))
def sector_targets(spark, base):
    d = md.sector_targets(src.l2_bars(spark, base))
    return d.select("code", "dt", rd("fwd_mean").alias("fwd_mean"), "tercile", "outperform")


@query(with_ctes(f"SELECT dt, {r('f')} AS fwd_ret, CASE WHEN f IS NULL THEN NULL WHEN f > 0 THEN 1 ELSE 0 END AS fwd_dir FROM (SELECT dt, (lead(close, 20) {D} / close - 1) * 100 AS f FROM mkt)"))
def market_targets(spark, base):
    d = md.market_targets(mkt.market_index(src.l1_bars(spark, base)))
    return d.select("dt", rd("fwd_ret").alias("fwd_ret"), "fwd_dir")


# ---- models (numbers depend on the trainer: rows are checked) -------------------------------

MODEL_COLS = ["mom5", "mom20", "ma20_dev", "vol_ratio", "atr_pct", "pos20"]


def labelled(spark, base, bars=None):
    bars = src.instrument_bars(spark, base) if bars is None else bars
    d = md.ordinal_labels(feats(spark, base, bars))
    return d.select("code", "dt", "fwd_ret", "y_label", "weight", *[nz(c).alias(c) for c in MODEL_COLS])


@query()
def engine_walk_forward(spark, base):
    p = md.walk_forward(labelled(spark, base), MODEL_COLS, train0=1000, val=300, step=500, trees=8)
    return md.evaluate_folds(p).select("fold", "n_rows", "n_dates", rd("rank_ic").alias("rank_ic"), rd("auc").alias("auc"))


@query()
def size_group_rerank(spark, base):
    from ..operators.cross import size_groups
    from ..operators.snapshots import latest_rows

    # the three fits read the rows and the groups many times
    bars = materialised(src.instrument_bars(spark, base))
    d, groups = materialised(labelled(spark, base, bars)), materialised(size_groups(bars).select("code", "size_group"))
    discard(bars)
    models = md.fit_group_regressors(d, groups, MODEL_COLS, rounds=3)
    newest = latest_rows(d.select("code", "dt", *MODEL_COLS))
    return md.rerank(newest.select("code"), newest, models, groups).select("code", rd("ml_pred").alias("ml_pred"), rd("ml_score").alias("ml_score"))


cte("imp", f"SELECT f.fold, x.name AS feature, abs(corr(x.v, s.fwd_ret)) AS importance FROM feat p JOIN scores s USING (code, dt) JOIN folds f ON p.dt BETWEEN f.val_start AND f.val_end, LATERAL (SELECT unnest([{{'name': 'mom5', 'v': p.mom5}}, {{'name': 'mom20', 'v': p.mom20}}, {{'name': 'atr_pct', 'v': p.atr_pct}}, {{'name': 'vol_ratio', 'v': p.vol_ratio}}]) AS x) GROUP BY f.fold, x.name")


@query(with_ctes(f"SELECT feature, {r('avg(rk)')} AS mean_rank, {r('stddev_samp(rk)')} AS rank_std, count(*) AS n_folds FROM (SELECT feature, rank() OVER (PARTITION BY fold ORDER BY importance DESC) AS rk FROM imp WHERE importance IS NOT NULL AND NOT isnan(importance)) GROUP BY feature"))
def rank_stability(spark, base):
    from ..operators.joins import trades_in_folds

    d = feats(spark, base).join(src.engine_scores(spark, base).select("code", "dt", "fwd_ret"), ["code", "dt"])
    d = trades_in_folds(d, folds(spark, base).select("fold", "val_start", "val_end"))
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("mom5", "mom20", "atr_pct", "vol_ratio")]))
    imp = d.select("fold", "fwd_ret", x.alias("_x")).groupBy("fold", "_x.feature").agg(F.abs(corr("_x.v", "fwd_ret")).alias("importance")).where("importance is not null and not isnan(importance)")
    return st.importance_stability(imp).select("feature", rd("mean_rank").alias("mean_rank"), rd("rank_std").alias("rank_std"), "n_folds")


# ---- sets, splits and scalar functions --------------------------------------------------------


@query(with_ctes("SELECT dt, 'both' AS kind FROM (SELECT DISTINCT dt FROM panel INTERSECT SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders) UNION ALL SELECT dt, 'bars_only' FROM (SELECT DISTINCT dt FROM panel EXCEPT SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)"))
def date_set_operations(spark, base):
    bars = src.trade_ticks(spark, base).select("dt").distinct()
    orders = table(spark, base, "orders").select(F.to_date("o_orderdate").alias("dt")).distinct()
    return bars.intersect(orders).withColumn("kind", F.lit("both")).unionByName(bars.subtract(orders).withColumn("kind", F.lit("bars_only")))


@query(with_ctes(f"SELECT code, dt, {r('close')} AS close, NULL::DOUBLE AS score FROM panel WHERE dt < DATE '1998-01-01' UNION ALL SELECT code, dt, {r('close')} AS close, p_momentum AS score FROM scores WHERE dt >= DATE '1998-01-01'"))
def union_with_schema(spark, base):
    old = src.instrument_bars(spark, base).where("dt < date'1998-01-01'").select("code", "dt", rd("close").alias("close"))
    new = src.engine_scores(spark, base).where("dt >= date'1998-01-01'").select("code", "dt", rd("close").alias("close"), F.col("p_momentum").alias("score"))
    return old.unionByName(new, allowMissingColumns=True).select("code", "dt", "close", "score")


@query("SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt, max(l_orderkey) AS last_order FROM lineitem GROUP BY 1, 2")
def deduplicate_keys(spark, base):
    d = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("dt"), F.col("l_orderkey").alias("last_order"))
    return d.groupBy("code", "dt").agg(F.max("last_order").alias("last_order"))


@query(with_ctes("SELECT dt, " + ", ".join(f"{r(f'max(close) FILTER (code = {k})')} AS region_{k}" for k in range(5)) + " FROM l1panel GROUP BY dt"))
def pivot_regions(spark, base):
    d = src.l1_bars(spark, base).groupBy("dt").pivot("code", list(range(5))).agg(F.max("close"))
    return d.select("dt", *[rd(str(k)).alias(f"region_{k}") for k in range(5)])


@query(with_ctes("SELECT part, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM (SELECT p.dt, CASE WHEN c.date_idx <= n * 0.6 THEN 'train' WHEN c.date_idx <= n * 0.8 THEN 'val' ELSE 'test' END AS part FROM panel p JOIN calendar c USING (dt), (SELECT max(date_idx) AS n FROM calendar)) GROUP BY part"))
def date_split(spark, base):
    bars = src.instrument_bars(spark, base)
    cal = ingest.trading_calendar(bars)
    n = cal.agg(F.max("date_idx")).scalar()
    d = bars.join(cal, "dt").withColumn("part", F.when(F.col("date_idx") <= n * 0.6, "train").when(F.col("date_idx") <= n * 0.8, "val").otherwise("test"))
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query(with_ctes(f"SELECT code, dt, {rsel({'ln_close': 'ln(close)', 'l1p': 'ln(1 + vol)', 'lg': 'log10(amount)', 'rt': 'sqrt(vol)', 'th': 'tanh(vol / 100)', 'sg': 'sign(close - open)', 'cl': 'least(greatest(vol, 5), 40)'})} FROM panel"))
def math_functions(spark, base):
    d = src.instrument_bars(spark, base)
    cols = {"ln_close": F.log("close"), "l1p": F.log1p("vol"), "lg": F.log10("amount"), "rt": F.sqrt("vol"), "th": F.tanh(F.col("vol") / 100), "sg": F.signum(F.col("close") - F.col("open")), "cl": clip("vol", 5, 40)}
    return shown(d.select("code", "dt", *[e.alias(k) for k, e in cols.items()]), list(cols))


@query("SELECT s_suppkey AS code, upper(s_name) AS up, contains(s_name, '9') AS has9, starts_with(s_name, 'Supplier') AS pre, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits, split_part(s_name, '#', 1) AS head, printf('%06d.XS', CAST(s_suppkey AS BIGINT)) AS symbol FROM supplier")
def string_functions(spark, base):
    n = F.col("s_name")
    return table(spark, base, "supplier").select(
        F.col("s_suppkey").alias("code"), F.upper(n).alias("up"), n.contains("9").alias("has9"), n.startswith("Supplier").alias("pre"), F.regexp_replace(n, "[^0-9]", "").alias("digits"), F.split_part(n, F.lit("#"), F.lit(1)).alias("head"), F.format_string("%06d.XS", "s_suppkey").alias("symbol"),
    )


@query(with_ctes("SELECT d.dt, c.dt AS four_weeks_back FROM calendar d ASOF LEFT JOIN calendar c ON d.dt - 28 >= c.dt"))
def weeks_back(spark, base):
    cal = ingest.trading_calendar(src.trade_ticks(spark, base))
    days = cal.select(F.date_sub("dt", 28).alias("dt"))
    d = ingest.nearest_trading_day(days, cal)
    return d.select(F.date_add("dt", 28).alias("dt"), F.col("trade_dt").alias("four_weeks_back"))


@query(with_ctes(f"SELECT code, {r('list_max(t)', 3)} AS top, {r('t[1]', 3)} AS oldest, len([x FOR x IN t IF x > 0.5]) AS n_high, list_bool_or([x > 0.9 FOR x IN t]) AS any_high FROM (SELECT code, list(p_momentum ORDER BY dt) AS t FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM scores) WHERE k <= 10 GROUP BY code)"))
def array_functions(spark, base):
    d = st.score_trend(src.engine_scores(spark, base), "p_momentum")
    return d.select("code", rd(F.array_max("trend"), 3).alias("top"), rd(F.element_at("trend", 1), 3).alias("oldest"), F.size(F.filter("trend", lambda x: x > 0.5)).cast("long").alias("n_high"), F.exists("trend", lambda x: x > 0.9).alias("any_high"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def json_fields(spark, base):
    return table(spark, base, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("ok"))


@query(with_ctes(f"SELECT code, dt, {rsel({'filled': 'coalesce(pct_chg, 0)', 'inv': '1 / nullif(buy_elg_amount, 0) * 1000'})}, pct_chg IS NULL AS missing FROM panel JOIN moneyflow USING (code, dt)"))
def null_handling(spark, base):
    d = src.instrument_panel(spark, base).join(src.moneyflow(spark, base), ["code", "dt"])
    return d.select("code", "dt", rd(nz("pct_chg")).alias("filled"), rd(F.lit(1.0) / F.nullif(F.col("buy_elg_amount"), F.lit(0.0)) * 1000).alias("inv"), F.col("pct_chg").isNull().alias("missing"))

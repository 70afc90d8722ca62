"""Statistics over predictions, trades and folds."""

from pyspark.sql import functions as F

from ..functions.scalar import corr, nz, rd
from ..operators import cross, indicators as ind, industry as iops, market as mkt, studies as st
from ..operators.snapshots import latest_rows
from ..session import materialised
from ..sources import bars as src
from .ctes import W, cte, over, r, with_ctes
from .industry import pct_rank_sql
from .market import D, d_over
from .registry import query
from .rules import feats, folds, trades
from .windows import rsel, shown

STAT = ["avg_return", "median_return", "max_return", "min_return", "std_return", "win_gt0", "win_gt5", "win_gt10", "win_gt20"]


def stats_sql(x):
    return f"""count(*) AS n, {rsel({'avg_return': f'avg({x})', 'median_return': f'median({x})', 'max_return': f'max({x})', 'min_return': f'min({x})', 'std_return': f'stddev_pop({x})',
      **{f'win_gt{v}': f'count(*) FILTER ({x} > {v}) * 100.0::DOUBLE / count(*)' for v in (0, 5, 10, 20)}})}"""


@query(with_ctes(f"SELECT rk, {stats_sql('d5_ret')} FROM trades WHERE d5_ret IS NOT NULL GROUP BY rk"))
def outcome_statistics(spark, base):
    d = st.outcome_stats(trades(spark, base), ["rk"], "d5_ret")
    return d.select("rk", "n", *[rd(c).alias(c) for c in STAT])


PTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query(with_ctes(f"SELECT {rsel({f'p{p}': f'quantile_cont(fwd_ret, {p / 100})' for p in PTS})} FROM scores"))
def percentile_panel(spark, base):
    d = materialised(src.engine_scores(spark, base).select("fwd_ret"))  # ranks read their input several times
    return st.percentile_panel(d, "fwd_ret").select(*[rd(f"p{p}").alias(f"p{p}") for p in PTS])


cte("qb", "SELECT f.mom20, s.d5_ret FROM feat f JOIN scores s USING (code, dt) WHERE f.mom20 IS NOT NULL")
cte("qb_e", "SELECT [quantile_cont(mom20, 0.1), quantile_cont(mom20, 0.2), quantile_cont(mom20, 0.3), quantile_cont(mom20, 0.4), quantile_cont(mom20, 0.5), quantile_cont(mom20, 0.6), quantile_cont(mom20, 0.7), quantile_cont(mom20, 0.8), quantile_cont(mom20, 0.9)] AS e FROM qb")


def scored_feats(spark, base):
    return src.with_engine_scores(feats(spark, base))


@query(with_ctes(f"SELECT bucket, {stats_sql('d5_ret')} FROM (SELECT CAST(len([v FOR v IN e IF v < mom20]) AS INTEGER) AS bucket, d5_ret FROM qb JOIN qb_e ON true) WHERE d5_ret IS NOT NULL GROUP BY bucket"))
def quantile_buckets(spark, base):
    d = materialised(scored_feats(spark, base).select("mom20", "d5_ret"))
    d = st.outcome_stats(st.with_quantile_bucket(d, "mom20", 10), ["bucket"], "d5_ret")
    return d.select("bucket", "n", *[rd(c).alias(c) for c in STAT])


@query(with_ctes(f"""SELECT bucket, {stats_sql('d5_ret')} FROM (SELECT CAST(greatest(least(ceil((ln(vol) - lo) / (hi - lo) * 20) - 1, 19), 0) AS INTEGER) AS bucket, d5_ret FROM scores, (SELECT min(ln(vol)) AS lo, max(ln(vol)) AS hi FROM scores)) WHERE d5_ret IS NOT NULL GROUP BY bucket"""))
def width_buckets(spark, base):
    d = src.engine_scores(spark, base).withColumn("lv", F.log("vol"))
    return st.outcome_stats(st.with_width_bucket(d, "lv", 20), ["bucket"], "d5_ret").select("bucket", "n", *[rd(c).alias(c) for c in STAT])


cte("risklab", f"""SELECT c.*, CASE WHEN n >= 3 AND (mn - fst) / fst <= -0.05 THEN 1 ELSE 0 END AS risk_label FROM (SELECT *, min(close) OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS mn,
  lead(close) {D} AS fst, count(*) OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM rskall) c""")


def risk_table(spark, base):
    d = mkt.risk_features(mkt.market_index(src.l1_bars(spark, base)), src.l2_bars(spark, base))
    return ind.forward_drawdown(d, 10, -0.05)


@query(with_ctes(f"""SELECT bucket, n, {r('rr')} AS risk_rate, min(up) OVER () AS monotonic, {r('arg_max(rr, bucket) OVER () / nullif(arg_min(rr, bucket) OVER (), 0)')} AS lift FROM (
  SELECT *, coalesce(rr >= lag(rr) OVER (ORDER BY bucket), true) AS up FROM (SELECT CAST(len([v FOR v IN e IF v < volume_shock]) AS INTEGER) AS bucket, count(*) AS n, avg(risk_label) * 100 AS rr FROM risklab,
  (SELECT [quantile_cont(volume_shock, k / 10.0) FOR k IN range(1, 10)] AS e FROM risklab) WHERE volume_shock IS NOT NULL GROUP BY 1))""".replace("[quantile_cont(volume_shock, k / 10.0) FOR k IN range(1, 10)]", "[" + ", ".join(f"quantile_cont(volume_shock, {k / 10})" for k in range(1, 10)) + "]")))
def factor_study(spark, base):
    d = st.factor_study(risk_table(spark, base), "volume_shock", "risk_label")
    return d.select("bucket", "n", rd("risk_rate").alias("risk_rate"), "monotonic", rd("lift").alias("lift"))


cte("confq", "SELECT volume_shock >= (SELECT quantile_cont(volume_shock, 0.8) FROM risklab) AS p, risk_label = 1 AS y FROM risklab WHERE volume_shock IS NOT NULL")


@query(with_ctes(f"""SELECT tp, fp, tn, fn, {rsel({'precision': 'coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)', 'recall': 'coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)', 'f1': 'coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)',
  'accuracy': '(tp + tn) / (tp + fp + tn + fn)::DOUBLE', 'alarm_pct': '(tp + fp) * 100 / (tp + fp + tn + fn)::DOUBLE'})} FROM (
  SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM confq)"""))
def confusion_matrix(spark, base):
    d = st.confusion(risk_table(spark, base), "volume_shock", "risk_label", 0.8)
    return d.select("tp", "fp", "tn", "fn", *[rd(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "alarm_pct")])


@query(with_ctes(f"""SELECT n_pos, n_neg, {r('(s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)', 6)} AS auc FROM (SELECT count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, sum(rk) FILTER (y) AS s FROM (
  SELECT fwd_ret > 0 AS y, rank() OVER (ORDER BY p_momentum) + (count(*) OVER (PARTITION BY p_momentum) - 1) / 2.0 AS rk FROM scores WHERE fwd_ret IS NOT NULL))"""))
def auc(spark, base):
    d = src.engine_scores(spark, base).where("fwd_ret is not null").withColumn("y", st.one_if(F.col("fwd_ret") > 0))
    return st.auc(d, "p_momentum", "y").select("n_pos", "n_neg", rd("auc", 6).alias("auc"))


def _ic_sql(pred):
    rk = lambda x: f"rank() OVER (PARTITION BY dt ORDER BY {x}) + (count(*) OVER (PARTITION BY dt, {x}) - 1) / 2.0"
    return f"""SELECT dt, n, {r('ic', 6)} AS ic FROM (SELECT dt, count(*) AS n, corr(a, b) AS ic FROM (SELECT dt, {rk('p')} AS a, {rk('fwd_ret')} AS b FROM (
      SELECT dt, fwd_ret, {pred} AS p FROM scores WHERE fwd_ret IS NOT NULL)) GROUP BY dt) WHERE n >= 10 AND ic IS NOT NULL AND NOT isnan(ic)"""


def ranked_scores(spark, base):
    return materialised(src.engine_scores(spark, base).select("code", "dt", "p_momentum", "fwd_ret"))


@query(with_ctes(_ic_sql("CASE WHEN fwd_ret > 2 THEN p_momentum * 2 ELSE p_momentum END")))
def rank_ic(spark, base):
    return st.rank_ic(ranked_scores(spark, base), "p_momentum", "fwd_ret", boost=2.0).withColumn("ic", rd("ic", 6))


@query(with_ctes(_ic_sql("p_momentum")))
def rank_ic_plain(spark, base):
    return st.rank_ic(ranked_scores(spark, base), "p_momentum", "fwd_ret").withColumn("ic", rd("ic", 6))


@query(with_ctes(f"""SELECT count(*) AS n_dates, {r('sum(w) / nullif(sum(t), 0)')} AS actual_win_rate, {r('avg(v)')} AS avg_volatility FROM (SELECT dt, avg(atr_pct) AS v, count(*) FILTER (fwd_ret > 0) AS w, count(fwd_ret) AS t FROM (
  SELECT s.dt, s.fwd_ret, f.atr_pct, row_number() OVER (PARTITION BY s.dt ORDER BY p_momentum DESC, s.code) AS k, count(*) OVER (PARTITION BY s.dt) AS n FROM scores s JOIN feat f USING (code, dt)) WHERE k <= 5 AND n >= 5 GROUP BY dt)"""))
def topn_win_rate(spark, base):
    d = st.topn_panel(scored_feats(spark, base), "p_momentum", "fwd_ret", "atr_pct")
    return d.select("n_dates", rd("actual_win_rate").alias("actual_win_rate"), rd("avg_volatility").alias("avg_volatility"))


@query(with_ctes(f"""SELECT count(*) FILTER (k <= 0.25) AS n_top, count(*) FILTER (k >= 0.75) AS n_bottom, {rsel({'top_avg': 'avg(d5_ret) FILTER (k <= 0.25)', 'bottom_avg': 'avg(d5_ret) FILTER (k >= 0.75)',
  'separation': 'avg(d5_ret) FILTER (k <= 0.25) - avg(d5_ret) FILTER (k >= 0.75)', 'top_win': 'count(*) FILTER (k <= 0.25 AND d5_ret > 0) * 100.0 / count(*) FILTER (k <= 0.25)'})} FROM (
  SELECT d5_ret, {pct_rank_sql('p_momentum DESC', 'dt', 1).replace('PARTITION BY dt, p_momentum DESC', 'PARTITION BY dt, p_momentum').replace('count(p_momentum DESC)', 'count(p_momentum)')} AS k FROM scores WHERE d5_ret IS NOT NULL)"""))
def separation_score(spark, base):
    d = st.separation(src.engine_scores(spark, base).where("d5_ret is not null"), "p_momentum", "d5_ret")
    return d.select("n_top", "n_bottom", *[rd(c).alias(c) for c in ("top_avg", "bottom_avg", "separation", "top_win")])


cte("concq", "SELECT t.code, f.fold, count(*) AS c FROM trades t JOIN folds f ON t.dt BETWEEN f.val_start AND f.val_end GROUP BY t.code, f.fold")
cte("concf", """SELECT fold, sum(c)::BIGINT AS n_trades, count(*) AS n_stocks, sum(c * c) / (sum(c) * sum(c))::DOUBLE AS hhi, sum((2 * k - n - 1) * c) / (max(n) * sum(c))::DOUBLE AS gini,
  max(c) / sum(c)::DOUBLE AS top1_pct, sum(c) FILTER (d <= 5) / sum(c)::DOUBLE AS top5_pct, sum(c) FILTER (d <= 10) / sum(c)::DOUBLE AS top10_pct, count(*) FILTER (c = 1) AS single_appearance, count(*) FILTER (c >= 5) AS core_holdings
  FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY c) AS k, row_number() OVER (PARTITION BY fold ORDER BY c DESC) AS d, count(*) OVER (PARTITION BY fold) AS n FROM concq) GROUP BY fold""")


def fold_trades(spark, base):
    from ..operators.joins import trades_in_folds

    return trades_in_folds(trades(spark, base), folds(spark, base).select("fold", "val_start", "val_end"))


@query(with_ctes(f"SELECT fold, n_trades, n_stocks, {rsel({k: k for k in ('hhi', 'gini', 'top1_pct', 'top5_pct', 'top10_pct')}, 6)}, single_appearance, core_holdings FROM concf"))
def concentration(spark, base):
    d = st.concentration(fold_trades(spark, base), ["fold"])
    return d.select("fold", "n_trades", "n_stocks", *[rd(c, 6).alias(c) for c in ("hhi", "gini", "top1_pct", "top5_pct", "top10_pct")], "single_appearance", "core_holdings")


cte("jac", """SELECT c.dt, 1 - b / (n + pn - b)::DOUBLE AS turnover FROM (SELECT a.dt, count(p.code) AS b FROM (SELECT t.dt, t.code, k.pd FROM trades t JOIN (SELECT dt, lag(dt) OVER (ORDER BY dt) AS pd FROM (SELECT DISTINCT dt FROM trades)) k USING (dt)) a
  LEFT JOIN trades p ON p.dt = a.pd AND p.code = a.code WHERE a.pd IS NOT NULL GROUP BY a.dt) c JOIN (SELECT dt, n, lag(n) OVER (ORDER BY dt) AS pn FROM (SELECT dt, count(*) AS n FROM trades GROUP BY dt)) z ON z.dt = c.dt""")


@query(with_ctes(f"SELECT dt, {r('turnover', 6)} AS turnover FROM jac"))
def jaccard_turnover(spark, base):
    return st.jaccard_turnover(trades(spark, base)).withColumn("turnover", rd("turnover", 6))


@query(with_ctes(f"SELECT count(*) AS n_periods, {rsel({'mean_turnover': 'avg(turnover)', 'high_turnover_pct': 'avg(CASE WHEN turnover > 0.8 THEN 1.0::DOUBLE ELSE 0 END)', 'median_turnover': 'median(turnover)'})} FROM jac"))
def turnover_summary(spark, base):
    d = st.turnover_summary(st.jaccard_turnover(trades(spark, base)))
    return d.select("n_periods", *[rd(c).alias(c) for c in ("mean_turnover", "high_turnover_pct", "median_turnover")])


cte("proxy", """SELECT t.dt, m.l1_name AS industry, count(*) AS n_trades, avg(CASE WHEN win_prob < 0.55 THEN 1.0::DOUBLE ELSE 0 END) AS low_wp_pct, avg(win_prob) AS mean_wp, avg(t1_ret) AS mean_t1, avg(d5_ret) AS mean_d5
  FROM trades t JOIN members m USING (code) GROUP BY t.dt, m.l1_name""")


def l1_industry(spark, base):
    return src.members(spark, base).select("code", F.col("l1_name").alias("industry"))


@query(with_ctes(f"SELECT dt, industry, n_trades, {rsel({k: k for k in ('low_wp_pct', 'mean_wp', 'mean_t1', 'mean_d5')})} FROM proxy"))
def industry_decay_proxy(spark, base):
    d = st.decay_proxy(trades(spark, base), l1_industry(spark, base))
    return d.select("dt", "industry", "n_trades", *[rd(c).alias(c) for c in ("low_wp_pct", "mean_wp", "mean_t1", "mean_d5")])


@query(with_ctes(f"""SELECT industry, week, {r('avg(low_wp_pct)')} AS low_wp_pct, sum(n_trades)::BIGINT AS n_trades FROM (SELECT *, CAST(date_trunc('week', dt) AS DATE) AS week FROM proxy)
  WHERE week IN (SELECT DISTINCT CAST(date_trunc('week', dt) AS DATE) AS w FROM proxy ORDER BY w DESC LIMIT 8) GROUP BY industry, week"""))
def decay_heatmap(spark, base):
    d = st.weekly_heatmap(st.decay_proxy(trades(spark, base), l1_industry(spark, base)), weeks=8)
    return d.select("industry", "week", rd("low_wp_pct").alias("low_wp_pct"), "n_trades")


@query(with_ctes(f"""SELECT industry, week, {r('avg(low_wp_pct)')} AS low_wp_pct, sum(n_trades)::BIGINT AS n_trades FROM (SELECT *, CAST(date_trunc('week', dt) AS DATE) AS week FROM proxy)
  WHERE industry IN (SELECT industry FROM proxy GROUP BY industry ORDER BY round(avg(low_wp_pct), 9) DESC, industry LIMIT 3) GROUP BY industry, week"""))
def decay_heatmap_top(spark, base):
    d = st.weekly_heatmap(st.decay_proxy(trades(spark, base), l1_industry(spark, base)), top=3)
    return d.select("industry", "week", rd("low_wp_pct").alias("low_wp_pct"), "n_trades")


FOLD_REGIME = "CASE CAST(fold % 3 AS INTEGER) WHEN 0 THEN 'bull' WHEN 1 THEN 'range' ELSE 'bear' END"
cte("foldt", f"""SELECT f.fold, f.val_start, f.val_end, f.n_dates, {FOLD_REGIME.replace('fold', 'f.fold')} AS regime, c.n_trades, c.hhi, c.gini, c.top5_pct, i.n_industries, i.t1_wr, i.d5_wr, i.gate_blocked, i.alpha_cut FROM folds f JOIN concf c ON c.fold = f.fold JOIN (
  SELECT f.fold, count(DISTINCT m.l1_name) AS n_industries, avg(CASE WHEN t1_ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS t1_wr, avg(CASE WHEN d5_ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS d5_wr,
  avg(CASE WHEN win_prob < 0.55 THEN 1.0::DOUBLE ELSE 0 END) AS gate_blocked, count(*) FILTER (win_prob < 0.55 * 0.75) AS alpha_cut FROM trades t JOIN folds f ON t.dt BETWEEN f.val_start AND f.val_end JOIN members m USING (code) GROUP BY f.fold) i ON i.fold = f.fold""")
FT = ("hhi", "gini", "top5_pct", "t1_wr", "d5_wr", "gate_blocked")


def fold_frame(spark, base):
    d = st.fold_table(folds(spark, base), fold_trades(spark, base), l1_industry(spark, base))
    k = F.col("fold") % 3
    return d.withColumn("regime", F.when(k == 0, "bull").when(k == 1, "range").otherwise("bear"))


@query(with_ctes(f"SELECT fold, regime, n_trades, n_industries, alpha_cut, {rsel({k: k for k in FT}, 6)} FROM foldt"))
def fold_table(spark, base):
    return fold_frame(spark, base).select("fold", "regime", "n_trades", "n_industries", "alpha_cut", *[rd(c, 6).alias(c) for c in FT])


cte("foldtemp", f"SELECT *, least(greatest((1 - {pct_rank_sql('gate_blocked', 'regime', 1)}) * 60 + 20, 0), 100) AS temp FROM foldt")


@query(with_ctes(f"SELECT fold, regime, {r('temp')} AS temp FROM foldtemp"))
def fold_temperature(spark, base):
    return st.fold_temperature(fold_frame(spark, base)).select("fold", "regime", rd("temp").alias("temp"))


@query(with_ctes(f"""SELECT cuts, count(*) AS n_folds, {rsel({'t1_wr': 'avg(t1_wr)', 'd5_wr': 'avg(d5_wr)', 'gate_blocked': 'avg(gate_blocked)'}, 6)}, count(*) FILTER (regime = 'bull') AS n_bull, count(*) FILTER (regime = 'range') AS n_range, count(*) FILTER (regime = 'bear') AS n_bear
  FROM (SELECT *, CASE WHEN alpha_cut = 0 THEN '0' WHEN alpha_cut <= 3 THEN '1-3' WHEN alpha_cut <= 6 THEN '4-6' ELSE '>6' END AS cuts FROM foldt) GROUP BY cuts"""))
def alpha_cut_groups(spark, base):
    d = st.cut_groups(fold_frame(spark, base))
    return d.select("cuts", "n_folds", *[rd(c, 6).alias(c) for c in ("t1_wr", "d5_wr", "gate_blocked")], "n_bull", "n_range", "n_bear")


@query(with_ctes(f"""SELECT regime, temp_q, n_folds, {rsel({k: k for k in ('t1_wr', 'd5_wr', 'alpha_cut')}, 6)}, CASE WHEN t1_wr >= 0.55 AND d5_wr >= 0.5 THEN 5 WHEN t1_wr >= 0.45 THEN 3 WHEN t1_wr >= 0.35 THEN 2 ELSE 1 END AS size FROM (
  SELECT regime, temp_q, count(*) AS n_folds, avg(t1_wr) AS t1_wr, avg(d5_wr) AS d5_wr, avg(alpha_cut) AS alpha_cut FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY round(temp, 9), fold) - 1) * 3 / count(*) OVER ()) AS INTEGER) AS temp_q FROM foldtemp) GROUP BY regime, temp_q HAVING count(*) >= 2)"""))
def position_rules(spark, base):
    d = st.position_rules(st.fold_temperature(fold_frame(spark, base)).withColumn("temp", F.round("temp", 9)))
    return d.select("regime", "temp_q", "n_folds", *[rd(c, 6).alias(c) for c in ("t1_wr", "d5_wr", "alpha_cut")], "size")


@query(with_ctes(f"SELECT {rsel({'hhi_t1': 'corr(hhi, t1_wr)', 'hhi_d5': 'corr(hhi, d5_wr)', 'gate_t1': 'corr(gate_blocked, t1_wr)', 'gate_d5': 'corr(gate_blocked, d5_wr)'}, 6)} FROM foldt"))
def fold_correlations(spark, base):
    pairs = {"hhi_t1": ("hhi", "t1_wr"), "hhi_d5": ("hhi", "d5_wr"), "gate_t1": ("gate_blocked", "t1_wr"), "gate_d5": ("gate_blocked", "d5_wr")}
    return fold_frame(spark, base).agg(*[rd(F.when(F.count(a) > 0, nz(corr(a, b), float("nan"))), 6).alias(n) for n, (a, b) in pairs.items()])


@query(with_ctes(f"""SELECT coalesce(regime, 'ALL') AS regime, coalesce(CAST(rk AS VARCHAR), 'ALL') AS rk, count(*) AS n, {rsel({'avg_return': 'avg(d5_ret)', 'win_rate': 'count(*) FILTER (d5_ret > 0) * 100.0 / count(*)'})} FROM (
  SELECT t.rk, t.d5_ret, {FOLD_REGIME.replace('fold', 'f.fold')} AS regime FROM trades t JOIN folds f ON t.dt BETWEEN f.val_start AND f.val_end WHERE d5_ret IS NOT NULL) GROUP BY CUBE (regime, rk)"""))
def regime_bucket_cube(spark, base):
    k = F.col("fold") % 3
    d = fold_trades(spark, base).where("d5_ret is not null").withColumn("regime", F.when(k == 0, "bull").when(k == 1, "range").otherwise("bear"))
    d = d.cube("regime", "rk").agg(F.count(F.lit(1)).alias("n"), F.avg("d5_ret").alias("a"), st.share(F.col("d5_ret") > 0).alias("w"))
    return d.select(F.coalesce("regime", F.lit("ALL")).alias("regime"), F.coalesce(F.col("rk").cast("string"), F.lit("ALL")).alias("rk"), "n", rd("a").alias("avg_return"), rd("w").alias("win_rate"))


@query(with_ctes("""SELECT l1_name, count(DISTINCT t.code) AS n_codes, count(DISTINCT t.dt) AS n_dates, count(*) AS n_rows FROM trades t JOIN members m USING (code) GROUP BY l1_name"""))
def presence_counts(spark, base):
    d = trades(spark, base).join(src.members(spark, base).select("code", "l1_name"), "code")
    return d.groupBy("l1_name").agg(F.countDistinct("code").alias("n_codes"), F.countDistinct("dt").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"))


cte("pmean", "SELECT code, dt, (p_momentum + p_reversion + p_breakout) / 3 AS p FROM scores")
cte("dd2", "SELECT (SELECT max(dt) FROM pmean WHERE dt <= DATE '2001-06-29') AS today, (SELECT max(dt) FROM pmean WHERE dt <= (SELECT max(dt) FROM pmean WHERE dt <= DATE '2001-06-29') - 28) AS past")
cte("decq", f"""SELECT code, p_today, p_past, {pct_rank_sql('p_today', '1')} AS rank_today, {pct_rank_sql('p_past', '1')} AS rank_past FROM (
  SELECT a.code, a.p AS p_today, b.p AS p_past FROM pmean a JOIN pmean b ON a.code = b.code JOIN dd2 ON a.dt = dd2.today AND b.dt = dd2.past)""".replace("OVER (PARTITION BY 1)", "OVER ()"))


def mean_probs(spark, base):
    return src.engine_scores(spark, base).select("code", "dt", ((F.col("p_momentum") + F.col("p_reversion") + F.col("p_breakout")) / 3).alias("p_mean"))


def decay_frame(spark, base):
    p = mean_probs(spark, base)
    today = p.where("dt <= date'2001-06-29'").agg(F.max("dt"))
    past = p.where(F.col("dt") <= F.date_sub(today.scalar(), 28)).agg(F.max("dt"))
    return st.decay_ranking(p, today.scalar(), past.scalar())


@query(with_ctes(f"SELECT code, {rsel({'p_today': 'p_today', 'p_past': 'p_past', 'rank_today': 'rank_today', 'rank_past': 'rank_past', 'decay': 'rank_today - rank_past'})} FROM decq"))
def decay_ranking(spark, base):
    return shown(decay_frame(spark, base), ["p_today", "p_past", "rank_today", "rank_past", "decay"], keys=("code",))


@query(with_ctes(f"SELECT m.l1_name AS industry, count(*) AS n, {rsel({'mean_decay': 'avg(rank_today - rank_past)', 'down_pct': 'count(*) FILTER (rank_today - rank_past < 0) * 100.0 / count(*)', 'median_decay': 'median(rank_today - rank_past)'})} FROM decq JOIN members m USING (code) GROUP BY 1"))
def sector_decay_stats(spark, base):
    d = st.sector_decay(decay_frame(spark, base), l1_industry(spark, base))
    return d.select("industry", "n", *[rd(c).alias(c) for c in ("mean_decay", "down_pct", "median_decay")])


@query(with_ctes(f"SELECT * FROM (SELECT code, {r('rank_today - rank_past')} AS decay FROM decq) ORDER BY decay DESC, code LIMIT 30"))
def top_risers(spark, base):
    return decay_frame(spark, base).select("code", rd("decay").alias("decay")).orderBy(F.desc("decay"), "code").limit(30)


def _rank_temp():
    parts = " + ".join(pct_rank_sql(f"p_{e}", "dt", 1) for e in ("momentum", "reversion", "breakout"))
    return f"SELECT dt, median(rk) * 60 + 20 AS temp, count(*) AS n FROM (SELECT dt, ({parts}) / 3 AS rk FROM scores) GROUP BY dt"


@query(with_ctes(f"SELECT dt, {r('temp')} AS temp, n, CASE WHEN temp < 35 THEN 'low' WHEN temp < 55 THEN 'mid' ELSE 'high' END AS level FROM ({_rank_temp()})"))
def daily_temperature(spark, base):
    from ..functions.ranks import exact_percentiles, with_pct_ranks

    s = src.engine_scores(spark, base).select("code", "dt", "p_momentum", "p_reversion", "p_breakout")
    d = with_pct_ranks(s, ["dt"], ["dt", "code"], {f"r{i}": f"p_{e}" for i, e in enumerate(("momentum", "reversion", "breakout"))}, scale=1.0)
    d = d.withColumn("rk", (F.col("r0") + F.col("r1") + F.col("r2")) / 3)
    med = exact_percentiles(d, ["dt"], "rk", {"m": 0.5}).join(d.groupBy("dt").agg(F.count(F.lit(1)).alias("n")), "dt")
    t = F.col("m") * 60 + 20
    return med.select("dt", rd(t).alias("temp"), "n", F.when(t < 35, "low").when(t < 55, "mid").otherwise("high").alias("level"))


@query(with_ctes(f"""SELECT dt, {r('CASE WHEN len(h) >= 60 THEN len([v FOR v IN h IF v <= p]) / len(h)::DOUBLE * 100 END')} AS temp FROM (SELECT dt, p, list(p) {d_over(250)} AS h FROM (SELECT dt, round(avg(p), 12) AS p FROM pmean GROUP BY dt))"""))
def trailing_temperature(spark, base):
    d = mean_probs(spark, base).groupBy("dt").agg(F.round(F.avg("p_mean"), 12).alias("p"))
    return mkt.ts_percentile(d, "p", "temp").select("dt", rd("temp").alias("temp"))


SIG = {"down_85": ("down_pct", ">=", 85), "down_70": ("down_pct", ">=", 70), "index_down_1": ("chg", "<=", -1.0), "expansion_12": ("expansion", ">=", 1.2),
       "high_minus_3": ("from_high", "<=", -0.03), "rsi_40": ("rsi", "<=", 40), "dev20_minus_3": ("dev20", "<=", -0.03), "dev60_minus_5": ("dev60", "<=", -0.05)}
cte("evday", f"""SELECT *, s5 / nullif(s20, 0) AS expansion, close / h20 - 1 AS from_high, close / m20 - 1 AS dev20, close / m60 - 1 AS dev60, coalesce(down_pct >= 70 AND chg <= -2.5, false) AS ev,
  CASE WHEN i > 14 AND lo > 0 THEN 100 - 100 / (1 + gn / lo) END AS rsi FROM (SELECT k.*, b.down_pct, CASE WHEN i > 5 THEN stddev_samp(ret) {d_over(5).replace('ORDER BY dt', 'ORDER BY k.dt')} END AS s5, CASE WHEN i > 20 THEN stddev_samp(ret) {d_over(20).replace('ORDER BY dt', 'ORDER BY k.dt')} END AS s20,
  CASE WHEN i >= 20 THEN max(close) {d_over(20).replace('ORDER BY dt', 'ORDER BY k.dt')} END AS h20, CASE WHEN i >= 20 THEN avg(close) {d_over(20).replace('ORDER BY dt', 'ORDER BY k.dt')} END AS m20, CASE WHEN i >= 60 THEN avg(close) {d_over(60).replace('ORDER BY dt', 'ORDER BY k.dt')} END AS m60,
  avg(greatest(d, 0)) {d_over(14).replace('ORDER BY dt', 'ORDER BY k.dt')} AS gn, avg(greatest(-d, 0)) {d_over(14).replace('ORDER BY dt', 'ORDER BY k.dt')} AS lo
  FROM (SELECT *, close / lag(close) {D} - 1 AS ret, (close / lag(close) {D} - 1) * 100 AS chg, close - lag(close) {D} AS d FROM mkt) k JOIN l2breadth b USING (dt))""")


def event_days(spark, base):
    idx = mkt.market_index(src.l1_bars(spark, base))
    d = ind.rsi_sma(idx, (14,)).withColumn("ret", ind.momentum(1) / 100)
    d = d.select("dt", "close", F.col("rsi_14").alias("rsi"), (F.col("ret") * 100).alias("chg"), ind.div0(ind.std_n("ret", 5, 5), ind.std_n("ret", 20, 20)).alias("expansion"),
                 (F.col("close") / ind.max_n("close", 20, 20) - 1).alias("from_high"), (F.col("close") / ind.mean_n("close", 20, 20) - 1).alias("dev20"), (F.col("close") / ind.mean_n("close", 60, 60) - 1).alias("dev60"))
    d = d.join(mkt.breadth(src.with_change(src.l2_bars(spark, base))).select("dt", "down_pct"), "dt")
    return d.withColumn("ev", F.coalesce((F.col("down_pct") >= 70) & (F.col("chg") <= -2.5), F.lit(False)))


def _event_sql():
    structs = ", ".join(f"{{'signal': '{n}', 'hit': {c} {o} {v}}}" for n, (c, o, v) in SIG.items())
    return f"""SELECT signal, hits_before, checks, {rsel({'hit_rate': 'h', 'random_rate': 'q', 'lift': 'coalesce(h / nullif(q, 0), 1)'})} FROM (SELECT s.signal AS signal, sum(near * CASE WHEN s.hit THEN 1 ELSE 0 END)::BIGINT AS hits_before, sum(near)::BIGINT AS checks,
      coalesce(sum(near * CASE WHEN s.hit THEN 1 ELSE 0 END) * 100.0::DOUBLE / nullif(sum(near), 0), 0) AS h, coalesce(count(*) FILTER (NOT ev AND s.hit) * 100.0::DOUBLE / nullif(count(*) FILTER (NOT ev), 0), 0) AS q FROM (
      SELECT ev, coalesce(count(*) FILTER (ev) OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS near, unnest([{structs}]) AS s FROM evday) WHERE s.hit IS NOT NULL GROUP BY s.signal)"""


@query(with_ctes(_event_sql()))
def event_study(spark, base):
    sig = {n: (F.col(c) >= v if o == ">=" else F.col(c) <= v) for n, (c, o, v) in SIG.items()}
    d = st.event_study(event_days(spark, base), "ev", sig)
    return d.select("signal", "hits_before", "checks", rd("hit_rate").alias("hit_rate"), rd("random_rate").alias("random_rate"), rd("lift").alias("lift"))


COMBO = {"high_or_rsi": "from_high <= -0.02 OR rsi <= 40", "dev20": "dev20 <= -0.03", "high": "from_high <= -0.03", "expansion_and_high": "expansion >= 1.2 AND from_high <= -0.02",
         "high_and_breadth": "from_high <= -0.02 AND down_pct >= 70", "dev60": "dev60 <= -0.03"}


def _combo_sql():
    structs = ", ".join(f"{{'combo': '{n}', 'hit': coalesce({e}, false), 'warned': coalesce(bool_or(coalesce({e}, false)) OVER (ORDER BY dt ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false)}}" for n, e in COMBO.items())
    return f"""SELECT combo, n_events, warned, false_alarms, triggers, {rsel({'coverage': 'coalesce(warned * 100.0 / nullif(n_events, 0), 0)', 'precision': 'coalesce(warned * 100.0 / nullif(warned + false_alarms, 0), 0)'})} FROM (
      SELECT s.combo AS combo, count(*) FILTER (ev) AS n_events, count(*) FILTER (ev AND s.warned) AS warned, count(*) FILTER (NOT ev AND j > 3 AND s.hit AND NOT soon) AS false_alarms, count(*) FILTER (j > 3 AND s.hit) AS triggers FROM (
      SELECT ev, j, soon, unnest(ss) AS s FROM (SELECT ev, row_number() OVER (ORDER BY dt) AS j, coalesce(bool_or(ev) OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS soon, [{structs}] AS ss FROM evday)) GROUP BY s.combo)"""


@query(with_ctes(_combo_sql()))
def combination_study(spark, base):
    d = st.combination_study(event_days(spark, base), "ev", {n: F.expr(e) for n, e in COMBO.items()})
    return d.select("combo", "n_events", "warned", "false_alarms", "triggers", rd("coverage").alias("coverage"), rd("precision").alias("precision"))


EV4 = {"drop_5d": "ret5 <= -3", "extreme_day": "down_pct >= 90 AND chg <= -2.5", "slide_10d": "ret10 <= -5", "broad_day": "down_pct >= 90"}
PH = {"phase1": "phase1", "phase2": "phase2", "phase3": "phase3", "phase1_or_2": "phase1 OR phase2", "any_phase": "phase1 OR phase2 OR phase3"}


def _prec_sql():
    nxt = "OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING)"
    firsts = ", ".join(f"min(j) FILTER (coalesce({e}, false)) {nxt} AS f_{k}" for k, e in EV4.items())
    structs = ", ".join(f"{{'phase': '{p}', 'is_on': {c}, 'event': '{k}', 'ld': f_{k} - j}}" for p, c in PH.items() for k in EV4)
    return f"""SELECT s.phase AS phase, s.event AS event, count(*) AS n_triggers, count(s.ld) AS hits, {r('count(s.ld) * 100.0 / count(*)')} AS precision, {r('avg(s.ld)')} AS mean_lead FROM (
      SELECT unnest([{structs}]) AS s FROM (SELECT *, count(*) {nxt} AS lft, {firsts} FROM warns) WHERE lft >= 3) WHERE s.is_on GROUP BY s.phase, s.event"""


@query(with_ctes(_prec_sql()))
def warning_precision(spark, base):
    w = mkt.warning_signals(mkt.market_index(src.l1_bars(spark, base)), mkt.breadth(src.with_change(src.l2_bars(spark, base))))
    d = st.warning_precision(w)
    return d.select("phase", "event", "n_triggers", "hits", rd("precision").alias("precision"), rd("mean_lead").alias("mean_lead"))


@query(with_ctes(f"""SELECT dt, {r('down_pct')} AS down_pct, {r('z')} AS z, CASE WHEN abs(z) > 3 THEN 'severe' WHEN abs(z) > 2 THEN 'warning' ELSE 'normal' END AS level FROM (SELECT dt, down_pct, CASE WHEN n >= 20 THEN round((down_pct - m) / nullif(s, 0), 9) END AS z FROM (
  SELECT dt, down_pct, avg(down_pct) OVER w AS m, CASE WHEN max(down_pct) OVER w > min(down_pct) OVER w THEN stddev_pop(down_pct) OVER w END AS s, count(*) OVER w AS n FROM l2breadth WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))"""))
def anomaly_scores(spark, base):
    d = st.anomaly_scores(mkt.breadth(src.with_change(src.l2_bars(spark, base))), "down_pct")
    return d.select("dt", rd("down_pct").alias("down_pct"), rd("z").alias("z"), "level")


@query(with_ctes(f"SELECT code, array_to_string(list(CAST(CAST(round(p_momentum * 1000) AS INTEGER) AS VARCHAR) ORDER BY dt), ',') AS trend, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM scores) WHERE k <= 10 GROUP BY code"))
def persistence_trend(spark, base):
    d = src.engine_scores(spark, base).select("code", "dt", F.round(F.col("p_momentum") * 1000).cast("int").cast("string").alias("v"))
    return st.score_trend(d, "v").select("code", F.array_join("trend", ",").alias("trend"), "n")


@query(with_ctes(f"""SELECT dt, code, rank_mom20, {rsel({'rank_vol_ratio': 'rv', 'z_mom20': 'z'})} FROM (SELECT dt, code, {r(pct_rank_sql('mom20', 'dt'))} AS rank_mom20, {pct_rank_sql('vol_ratio', 'dt')} AS rv,
  CASE WHEN stddev_samp(mom20) OVER (PARTITION BY dt) > 1e-10 THEN (mom20 - avg(mom20) OVER (PARTITION BY dt)) / stddev_samp(mom20) OVER (PARTITION BY dt) ELSE 0 END AS z FROM feat WHERE mom20 IS NOT NULL)"""))
def cross_section_ranks(spark, base):
    from ..functions.ranks import with_pct_ranks

    f = materialised(feats(spark, base).where("mom20 is not null").select("dt", "code", "mom20", "vol_ratio"))
    d = with_pct_ranks(f, ["dt"], ["dt", "code"], {"rank_mom20": "mom20", "rank_vol_ratio": "vol_ratio"})
    d = cross.zscores(d, ["dt"], {"z_mom20": "mom20"})
    return shown(d, ["rank_mom20", "rank_vol_ratio", "z_mom20"], keys=("dt", "code"))


@query(with_ctes(f"""SELECT dt, code, {r('CASE WHEN hi - lo < 1e-10 THEN 5 ELSE (mom20 - lo) / nullif(hi - lo, 0) * 10 END')} AS score FROM (SELECT dt, code, mom20, min(mom20) OVER (PARTITION BY dt) AS lo, max(mom20) OVER (PARTITION BY dt) AS hi FROM feat WHERE mom20 IS NOT NULL)"""))
def minmax_by_date(spark, base):
    f = feats(spark, base).where("mom20 is not null").select("dt", "code", "mom20")
    return shown(cross.minmax(f, ["dt"], {"score": "mom20"}), ["score"], keys=("dt", "code"))


@query(with_ctes(f"""SELECT dt, code, {r('p_momentum')} AS p_momentum, CAST(rk AS INTEGER) AS rk, side FROM (SELECT dt, code, p_momentum, row_number() OVER (PARTITION BY dt ORDER BY p_momentum DESC, code) AS rk, 'top' AS side FROM scores
  UNION ALL SELECT dt, code, p_momentum, row_number() OVER (PARTITION BY dt ORDER BY p_momentum, code), 'bottom' FROM scores) WHERE rk <= 5"""))
def top_bottom_by_date(spark, base):
    s = src.engine_scores(spark, base).select("dt", "code", "p_momentum")
    d = cross.top_n(s, ["dt"], "p_momentum", 5).withColumn("side", F.lit("top")).unionByName(cross.top_n(s, ["dt"], "p_momentum", 5, largest=False).withColumn("side", F.lit("bottom")))
    return d.select("dt", "code", rd("p_momentum").alias("p_momentum"), "rk", "side")


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close, {r('vol')} AS vol FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM panel WHERE dt <= DATE '2000-12-29') WHERE k = 1"""))
def latest_snapshot(spark, base):
    d = latest_rows(src.instrument_bars(spark, base), asof=F.lit("2000-12-29").cast("date"))
    return shown(d, ["close", "vol"])

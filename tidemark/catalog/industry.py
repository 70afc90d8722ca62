"""Industry roll-ups, leading signals, persistence and zones."""

from pyspark.sql import functions as F

from ..functions.ewm import span_rate, with_ewm_adjusted
from ..functions.scalar import rd
from ..operators import indicators as ind, industry as ops, market as mkt
from ..operators.snapshots import latest_rows
from ..sources import bars as src
from .ctes import BAR, W, cte, mean, over, r, rolled, with_ctes
from .registry import query
from .windows import rsel, shown, walk

cte("mom_all", f"""SELECT *, (close / lag(close, 20) {W} - 1) * 100 AS m20, (close / lag(close, 5) {W} - 1) * 100 AS m5,
  {rolled('avg', 'close', 20, 20)} AS ma20, {rolled('avg', 'close', 5, 5)} AS ma5, max(i) OVER (PARTITION BY code) AS n FROM panel""")
cte("roll", """SELECT m.l2_name AS industry, m20, m5, close > ma20 AS a20, close > ma5 AS a5 FROM mom_all p JOIN members m ON p.code = m.code WHERE i = n AND n >= 21""")


@query(with_ctes(f"""SELECT industry, stock_count, {rsel({k: k for k in ('avg_return_20d', 'median_return_20d', 'avg_return_5d', 'reversal_strength', 'pct_positive', 'pct_above_ma20', 'pct_above_ma5')})},
  avg_return_20d < 0 AND reversal_strength > 5 AS is_reversal, CAST(row_number() OVER (ORDER BY avg_return_20d DESC, industry) AS INTEGER) AS rank FROM (
  SELECT industry, count(*) AS stock_count, avg(m20) AS avg_return_20d, median(m20) AS median_return_20d, avg(m5) AS avg_return_5d, avg(m5) - avg(m20) AS reversal_strength,
  avg(CASE WHEN m20 > 0 THEN 100.0 ELSE 0 END) AS pct_positive, avg(CASE WHEN a20 THEN 100.0 ELSE 0 END) AS pct_above_ma20, avg(CASE WHEN a5 THEN 100.0 ELSE 0 END) AS pct_above_ma5
  FROM roll GROUP BY industry HAVING count(*) >= 3)"""))
def industry_rollup(spark, base):
    d = ops.rollup(src.instrument_bars(spark, base), src.members(spark, base).withColumnRenamed("l2_name", "industry"))
    nums = ["avg_return_20d", "median_return_20d", "avg_return_5d", "reversal_strength", "pct_positive", "pct_above_ma20", "pct_above_ma5"]
    return d.select("industry", "stock_count", *[rd(c).alias(c) for c in nums], "is_reversal", "rank")


def _lead_sql(x):
    return f"SELECT * FROM (SELECT *, (close / lag(close, 20) {W} - 1) * 100 AS ret, max(i) OVER (PARTITION BY code) AS n FROM {x}) WHERE i = n AND n >= 21"


cte("leadq", f"""SELECT c.code, c.name, c.parent, c.parent_name, c.ret, c.ret - p.ret AS excess FROM ({_lead_sql('l2panel')}) c JOIN ({_lead_sql('l1panel')}) p ON p.code = c.parent""")


@query(with_ctes(f"""SELECT code, name, parent, parent_name, {r('ret')} AS ret, {r('excess')} AS excess,
  CASE WHEN excess >= 5 THEN 'strong_lead' WHEN excess >= 2 THEN 'lead' WHEN excess >= 0 THEN 'in_line' ELSE 'lagging' END AS label,
  CAST(row_number() OVER (ORDER BY excess DESC, code) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY parent ORDER BY excess DESC, code) AS INTEGER) AS rank_in_parent FROM leadq"""))
def leading_signals(spark, base):
    d = ops.leading(src.l2_bars(spark, base), src.l1_bars(spark, base))
    return d.withColumns({"ret": rd("ret"), "excess": rd("excess")})


cte("excessq", f"""SELECT s.code, s.ret AS own_ret, i.ret AS ind_ret, s.ret - i.ret AS excess FROM ({_lead_sql('panel')}) s JOIN members m ON m.code = s.code JOIN ({_lead_sql('l2panel')}) i ON i.code = m.l2""")


@query(with_ctes(f"SELECT code, {rsel({k: k for k in ('own_ret', 'ind_ret', 'excess')})} FROM excessq"))
def excess_over_industry(spark, base):
    from ..operators.joins import excess_over_parent

    return shown(excess_over_parent(src.instrument_bars(spark, base), src.members(spark, base).select("code", F.col("l2").alias("parent")), src.l2_bars(spark, base)),
                 ["own_ret", "ind_ret", "excess"], keys=("code",))


BOARD = "substr(CAST(p.code AS VARCHAR), 1, 2) IN ('30', '68')"
cte("lim", f"""SELECT dt, l2, count(*) FILTER (pct_chg >= lim) AS lt, count(*) FILTER (pct_chg <= -lim) AS dn, count(*) FILTER (pct_chg > 0) AS up, count(*) AS n FROM (
  SELECT p.dt, m.l2, p.pct_chg, CASE WHEN {BOARD} THEN 19.5 ELSE 9.5 END AS lim FROM panel p JOIN members m ON p.code = m.code) GROUP BY dt, l2""")


@query(with_ctes(f"SELECT dt, l2, {rsel({'lt_count': 'lt', 'dt_count': 'dn', 'lt_rate': 'lt / n::DOUBLE * 100', 'up_pct': 'up / n::DOUBLE * 100', 'lt_to_dt_ratio': 'coalesce(lt / nullif(lt + dn, 0)::DOUBLE, 0)'})}, n AS n_total FROM lim"))
def limit_move_ecology(spark, base):
    board = F.substring(F.col("code").cast("string"), 1, 2).isin("30", "68")
    d = ops.limit_moves(src.instrument_panel(spark, base), src.members(spark, base), "l2", board)
    return d.select("dt", "l2", *[rd(c).alias(c) for c in ("lt_count", "dt_count", "lt_rate", "up_pct", "lt_to_dt_ratio")], "n_total")


def pct_rank_sql(x, by, scale=100):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) * {scale}"


@query(with_ctes(f"""SELECT dt, l2, {r('ind_chg')} AS ind_chg, {r("CASE WHEN ind_chg IS NOT NULL THEN " + pct_rank_sql('ind_chg', 'dt') + " END")} AS ind_rank FROM (
  SELECT dt, l2, {mean('pct_chg')} AS ind_chg FROM panel JOIN members USING (code) GROUP BY dt, l2)"""))
def industry_day_rank(spark, base):
    return shown(ops.industry_day(src.instrument_panel(spark, base), src.members(spark, base), "l2"), ["ind_chg", "ind_rank"], keys=("dt", "l2"))


FEATS = ("mom5", "mom20", "ma20_dev", "vol_ratio")
cte("fewq", f"""SELECT code, dt, (close / lag(close, 5) {W} - 1) * 100 AS mom5, (close / lag(close, 20) {W} - 1) * 100 AS mom20,
  (close / avg(close) {over(20)} - 1) * 100 AS ma20_dev, vol / avg(vol) {over(20)} AS vol_ratio FROM panel""")


def few_features(spark, base):
    d = ind.moving_averages(ind.momenta(src.instrument_bars(spark, base), (5, 20)), (20,))
    return ind.volume_family(d).select("code", "dt", *FEATS)


@query(with_ctes(f"""SELECT dt, l2, {rsel({f'{k}_mean': f'avg({k})' for k in FEATS})}, {rsel({f'{k}_std': f'stddev_samp({k})' for k in FEATS})} FROM fewq JOIN members USING (code) GROUP BY dt, l2"""))
def industry_features(spark, base):
    d = ops.industry_features(few_features(spark, base), src.members(spark, base), "l2", FEATS, FEATS)
    return shown(d, [*[f"{k}_mean" for k in FEATS], *[f"{k}_std" for k in FEATS]], keys=("dt", "l2"))


@query(with_ctes(f"""SELECT dt, {rsel({f'{k}_mean': f'avg({k})' for k in FEATS})}, {rsel({f'{k}_std': f'stddev_samp({k})' for k in FEATS})},
  {rsel({f'{k}_q{q}': f'quantile_cont({k}, 0.{q})' for k in ('mom20', 'vol_ratio') for q in (25, 75)})} FROM fewq GROUP BY dt"""))
def market_features(spark, base):
    d = ops.market_features(few_features(spark, base), FEATS, FEATS, ("mom20", "vol_ratio"))
    return shown(d, [c for c in d.columns if c != "dt"], keys=("dt",))


@query(with_ctes(f"""SELECT l1, {r('mc')} AS margin_change, {r('pc')} AS price_change, mc < -3 AND pc > 0 AS diverges FROM (
  SELECT a.l1, (newm / oldm - 1) * 100 AS mc, coalesce(p.m5, 0) AS pc FROM (SELECT m.l1, avg(rzye) FILTER (k <= 5) AS newm, avg(rzye) FILTER (k > 5) AS oldm FROM margin g
  JOIN (SELECT dt, row_number() OVER (ORDER BY dt DESC) AS k FROM (SELECT DISTINCT dt FROM margin) ORDER BY dt DESC LIMIT 20) d ON d.dt = g.dt JOIN members m ON m.code = g.code GROUP BY m.l1) a
  JOIN (SELECT code, m5 FROM (SELECT code, i, (close / lag(close, 5) {W} - 1) * 100 AS m5, max(i) OVER (PARTITION BY code) AS n FROM l1panel) WHERE i = n) p ON p.code = a.l1 WHERE oldm > 0 AND newm IS NOT NULL)"""))
def margin_divergence(spark, base):
    d = ops.margin_divergence(src.margin(spark, base), src.members(spark, base), src.l1_bars(spark, base), "l1")
    return d.withColumns({"margin_change": rd("margin_change"), "price_change": rd("price_change")})


@query(with_ctes(f"""SELECT code, dt, {r('share', 6)} AS share, {r('m5')} AS mom5, {r('pct')} AS percentile, pct >= 90 AND m5 < 0 AS crowded FROM (
  SELECT *, len([v FOR v IN h IF v < share]) / 80.0::DOUBLE * 100 AS pct FROM (SELECT code, dt, share, coalesce((close / lag(close, 5) {W} - 1) * 100, 0) AS m5,
  list(share) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS h FROM (
  SELECT code, dt, close, amount / (sum(amount) OVER (PARTITION BY dt) + 1e-10) AS share FROM l2bars)) WHERE len(h) >= 80)"""))
def crowding(spark, base):
    d = ops.crowding(src.l2_bars(spark, base))
    return d.select("code", "dt", rd("share", 6).alias("share"), rd("mom5").alias("mom5"), rd("percentile").alias("percentile"), "crowded")


cte("isoweek", """SELECT code, isoyear(dt) AS iso_year, week(dt) AS iso_week, arg_max(close, dt) AS close, max(dt) AS dt FROM panel GROUP BY ALL""")


@query(with_ctes(f"SELECT code, CAST(iso_year AS INTEGER) AS iso_year, CAST(iso_week AS INTEGER) AS iso_week, {r('close')} AS close, dt FROM isoweek"))
def weekly_bars(spark, base):
    d = ops.weekly_bars(src.instrument_bars(spark, base))
    return d.select("code", F.col("iso_year").cast("int").alias("iso_year"), F.col("iso_week").cast("int").alias("iso_week"), rd("close").alias("close"), "dt")


cte("l2week", """SELECT code, arg_max(close, dt) AS close, max(dt) AS dt FROM l2panel GROUP BY code, isoyear(dt), week(dt)""")
cte("wmom", f"""SELECT code, dt, score, CAST(CASE WHEN score >= 6 THEN count(*) FILTER (score >= 6) OVER (PARTITION BY code, g ORDER BY dt) ELSE 0 END AS BIGINT) AS sustained FROM (
  SELECT *, count(*) FILTER (score < 6) OVER (PARTITION BY code ORDER BY dt) AS g FROM (
  SELECT code, dt, least(greatest(5 + (close / lag(close, 4) {W} - 1) * 100, 0), 10) AS score, lag(close, 4) {W} AS c4 FROM l2week) WHERE c4 IS NOT NULL)""")


@query(with_ctes(f"SELECT code, dt, {r('score')} AS weekly_momentum, sustained AS sustained_weeks, score >= 6 AND sustained >= 2 AS weekly_confirmed FROM wmom"))
def weekly_momentum(spark, base):
    d = ops.weekly_momentum(ops.weekly_bars(src.l2_bars(spark, base)))
    return d.withColumn("weekly_momentum", rd("weekly_momentum"))


cte("l2macd_src", "SELECT code, i, close, pre_close FROM l2panel")
walk("l2macd", "l2macd_src", ["ef", "es", "sg"], {"ef": "close", "es": "close", "sg": "0.0::DOUBLE"},
     {"ef": "r.ef + (b.close - r.ef) * 2 / 13.0", "es": "r.es + (b.close - r.es) * 2 / 27.0",
      "sg": "r.sg + ((r.ef + (b.close - r.ef) * 2 / 13.0) - (r.es + (b.close - r.es) * 2 / 27.0) - r.sg) * 2 / 10.0"}, [])
cte("l2gl", "SELECT code, i - 1 AS i, greatest(close - pre_close, 0) AS g, greatest(pre_close - close, 0) AS l FROM l2macd_src WHERE i > 1")
walk("l2rsiw", "l2gl", ["a", "z"], {"a": "g", "z": "l"}, {"a": "r.a * (1 - 1 / 14.0) + b.g / 14.0", "z": "r.z * (1 - 1 / 14.0) + b.l / 14.0"}, [])
cte("persq", f"""SELECT b.*, m.ef - m.es AS dif, m.sg AS sig, m.ef - m.es - m.sg AS hist, lag(m.ef - m.es) OVER w AS d1, lag(m.sg) OVER w AS s1,
  CASE WHEN z.z > 0 THEN 100 - 100 / (1 + z.a / z.z) WHEN z.z = 0 THEN 100 END AS rsi, avg(b.close) OVER w20 AS m20, stddev_samp(b.close) OVER w20 AS sd20,
  coalesce((b.close / lag(b.close, 20) OVER w - 1) * 100, 0) AS ret20, corr(b.close, b.i) OVER w20 AS cr, avg(b.vol) OVER wp AS pv, count(b.vol) OVER wp AS np,
  max(b.i) OVER (PARTITION BY b.code) AS n
  FROM l2panel b JOIN l2macd m ON b.code = m.code AND b.i = m.i LEFT JOIN l2rsiw z ON b.code = z.code AND b.i = z.i + 1
  WINDOW w AS (PARTITION BY b.code ORDER BY b.dt), w20 AS (PARTITION BY b.code ORDER BY b.dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  wp AS (PARTITION BY b.code ORDER BY b.dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
cte("persin", """SELECT code, dt, i, n, ret20, (least(greatest(5 + (coalesce(rsi, 50) - 50) / 5, 0), 10) + CASE WHEN dif > sig AND d1 <= s1 THEN 8 WHEN dif < sig AND d1 >= s1 THEN 2 ELSE 5 END
  + CASE WHEN 4 * sd20 < 1e-10 OR least(greatest((close - m20 + 2 * sd20) / (4 * sd20) * 100, 0), 100) BETWEEN 30 AND 70 THEN 8 ELSE 5 END
  + CASE WHEN (close - m20) / m20 * 100 > 2 THEN 8 WHEN (close - m20) / m20 * 100 < -2 THEN 3 ELSE 5 END) * 0.25::DOUBLE AS momentum_score,
  CASE WHEN np >= 20 AND pv > 0 THEN vol / pv ELSE 1 END AS turnover, coalesce(cr * cr, 0) * 10 AS stability FROM persq""")
cte("pers1", """SELECT *, ret20 / (avg(ret20) OVER () + 1e-10) AS rel FROM persin WHERE i = n AND n >= 21""")


def _mm(x):
    return f"CASE WHEN max({x}) OVER () - min({x}) OVER () < 1e-10 THEN 5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) * 10 END"


cte("pers2", f"""SELECT *, {_mm('ret20')} AS slope_score, {_mm('turnover')} AS turnover_score, {_mm('rel')} AS relative_score FROM pers1""")
cte("pers3", """SELECT *, round(momentum_score * 0.30 + slope_score * 0.25 + turnover_score * 0.20 + relative_score * 0.25 + 1e-6, 2) AS persistence_score FROM pers2""")


@query(with_ctes(f"""SELECT code, {rsel({k: k for k in ('momentum_score', 'slope_score', 'turnover_score', 'relative_score')})}, {r('stability', 3)} AS stability_score, persistence_score,
  CASE WHEN persistence_score >= 7 THEN 'high' WHEN persistence_score >= 5 THEN 'medium' ELSE 'low' END AS label,
  CAST(row_number() OVER (ORDER BY persistence_score DESC, code) AS INTEGER) AS rank FROM pers3""", recursive=True))
def persistence_score(spark, base):
    d = ops.persistence(src.l2_bars(spark, base))
    return d.select("code", *[rd(c).alias(c) for c in ("momentum_score", "slope_score", "turnover_score", "relative_score")],
                    rd("stability_score", 3).alias("stability_score"), "persistence_score", "label", "rank")


@query(with_ctes("""SELECT p.code, round(p.s + 1e-6, 2) AS persistence_score, CASE WHEN p.s >= 7 THEN 'high' WHEN p.s >= 5 THEN 'medium' ELSE 'low' END AS label FROM (
  SELECT p.code, CASE WHEN NOT w.ok THEN greatest(p.persistence_score - 1.5, 0) ELSE p.persistence_score END AS s FROM pers3 p LEFT JOIN (
  SELECT code, score >= 6 AND sustained >= 2 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM wmom) WHERE k = 1) w USING (code)) p""", recursive=True))
def weekly_filter(spark, base):
    bars = src.l2_bars(spark, base)
    newest = latest_rows(ops.weekly_momentum(ops.weekly_bars(bars)))
    d = ops.weekly_filter(ops.persistence(bars).select("code", "persistence_score"), newest)
    return d.select("code", rd("persistence_score", 2).alias("persistence_score"), "label")


@query(with_ctes(f"""SELECT code, dt, {r('s', 2)} AS persistence_score FROM (SELECT code, dt, momentum_score AS s FROM persin WHERE i >= 21)""", recursive=True))
def momentum_sub_score(spark, base):
    d = ops.persistence_inputs(src.l2_bars(spark, base)).where("n_bars >= 21")
    return d.select("code", "dt", rd("momentum_score", 2).alias("persistence_score"))


cte("zq0", f"""SELECT p.*, {rolled('avg', 'l', 14, 14)} AS al, {rolled('avg', 'g', 14, 14)} AS ag FROM (SELECT *, CASE WHEN pre_close IS NOT NULL THEN greatest(close - pre_close, 0) END AS g,
  CASE WHEN pre_close IS NOT NULL THEN greatest(pre_close - close, 0) END AS l FROM persq) p""")
cte("zq1", f"""SELECT *, coalesce(CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) END, 50) AS rsi14, {rolled('avg', 'close', 60, 60)} AS ma60, avg(vol) {over(5)} / avg(vol) {over(20)} AS vr,
  (close / lag(close, 5) {W} - 1) * 100 AS c5, list({{'c': close, 'h': hist}}) {over(60)} AS lst,
  avg(CASE WHEN pre_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END) {over(14)} AS atr,
  avg(high - low) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mr, lag(open) {W} AS o1, lag(close) {W} AS c1, lag(open, 2) {W} AS o2, lag(close, 2) {W} AS c2 FROM zq0""")
cte("zq2", """SELECT *, list_max([x.c FOR x IN lst]) AS pk, list_position([x.c FOR x IN lst], list_max([x.c FOR x IN lst])) AS pp FROM zq1 WHERE i >= 60""")
cte("zq3", """SELECT *, coalesce(pp > 1 AND pp < len(lst) AND close >= pk * 0.98 AND list_max([x.h FOR x IN lst[pp + 1:]]) < lst[pp].h, false) AS dvg,
  coalesce(c2 <> o2 AND close <> open AND c2 > o2 AND c2 - o2 > mr * 0.6 AND abs(c1 - o1) < (c2 - o2) * 0.3 AND close < open AND close < c2 - (c2 - o2) * 0.5, false) AS star,
  coalesce(close <> open AND c2 > o2 AND open > c2 AND close < o2 + (c2 - o2) * 0.5, false) AS cloud FROM zq2""")
cte("zq4", """SELECT *, CASE WHEN rsi14 > 70 THEN -2 WHEN rsi14 > 60 THEN 2 WHEN rsi14 > 50 THEN 1 WHEN rsi14 > 40 THEN 0 ELSE -1 END
  + CASE WHEN dif > 0 AND hist > 0 THEN 2 WHEN dif < 0 AND hist < 0 THEN -2 WHEN dif > 0 AND hist < 0 THEN -1 ELSE 0 END + CASE WHEN dvg THEN -3 ELSE 0 END + CASE WHEN star OR cloud THEN -3 ELSE 0 END
  + CASE WHEN vr < 0.8 AND c5 > 0 THEN -1 WHEN vr > 1.3 AND c5 > 0 THEN 2 ELSE 0 END + CASE WHEN close > m20 AND close > ma60 THEN 2 ELSE 0 END
  + CASE WHEN ret20 > 10 THEN -1 WHEN ret20 > 5 THEN 3 WHEN ret20 > 2 THEN 1 WHEN ret20 < -10 THEN 1 WHEN ret20 < -5 THEN -2 ELSE 0 END AS score FROM zq3""")
cte("zq5", """SELECT *, CASE WHEN rsi14 > 80 THEN 'top_warn' WHEN score >= 4 AND NOT (dvg OR star OR cloud) THEN 'chase' WHEN score <= -3 OR dvg OR star OR cloud THEN 'top_warn'
  WHEN score <= -1 OR rsi14 < 40 THEN 'weak' ELSE 'watch' END AS zone FROM zq4""")


@query(with_ctes(f"SELECT code, dt, {r('rsi14', 3)} AS rsi_14, dvg AS divergence, star OR cloud AS top_candle, CAST(score AS INTEGER) AS score, zone FROM zq5", recursive=True))
def industry_zone(spark, base):
    d = ops.zones(src.with_change(src.l2_bars(spark, base)))
    return d.select("code", "dt", rd("rsi_14", 3).alias("rsi_14"), "divergence", "top_candle", "score", "zone")


def _levels_sql():
    lv = lambda u, d: f"round(close * (1 + a * CASE WHEN ab THEN {u} ELSE {d} END) + 1e-6, 2)"
    return f"""SELECT code, dt, entry_low, entry_high, stop_loss, target_1, target_2, {r('(target_1 / close - 1) * 100', 1)} AS expected_return_t1, {r('(target_2 / close - 1) * 100', 1)} AS expected_return_t2,
      {r('(close - stop_loss) / close * 100', 1)} AS risk_pct, CASE WHEN close - stop_loss > 0 THEN {r('(target_1 - close) / nullif(close - stop_loss, 0)', 1)} ELSE 0 END AS reward_risk_t1 FROM (
      SELECT *, {lv(-0.5, -0.3)} AS entry_low, {lv(0.0, 0.2)} AS entry_high, {lv(-1.5, -1.2)} AS stop_loss, {lv(1.0, 0.8)} AS target_1, {lv(2.0, 1.5)} AS target_2 FROM (
      SELECT code, dt, close, atr / close AS a, close > m20 AS ab FROM (SELECT code, dt, close, i, avg(CASE WHEN pre_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END) {over(14)} AS atr,
      avg(close) {over(20)} AS m20 FROM weekpanel) WHERE i >= 20))"""


@query(with_ctes(_levels_sql()))
def price_levels(spark, base):
    d = src.week_bars(spark, base)
    d = d.select("*", ind.true_range().alias("tr"), F.row_number().over(ind.series()).alias("n"))
    d = d.select("*", ind.mean_n("tr", 14).alias("atr"), ind.mean_n("close", 20, 20).alias("ma20")).where("n >= 20")
    cols = ops.price_levels(F.col("close"), F.col("atr"), F.col("close") > F.col("ma20"))
    return d.select("code", "dt", *[e.alias(n) for n, e in cols.items()])


walk("l2adj", "l2panel", ["ef", "es"], {"ef": "close", "es": "close"}, {"ef": "r.ef + (b.close - r.ef) * 2 / 13.0", "es": "r.es + (b.close - r.es) * 2 / 27.0"}, ["close"])


def adjusted_sql(y, x0, i, span):
    """The weighted average of all values so far from the smoothed value that the first one seeds."""
    rest = f"pow(1 - 2 / {span + 1}.0::DOUBLE, {i})"
    return f"(({y} - {rest} * {x0}) / (1 - {rest}))"


cte("l2dif", f"""SELECT b.*, {adjusted_sql('m.ef', 'f', 'b.i', 12)} - {adjusted_sql('m.es', 'f', 'b.i', 26)} AS dif
  FROM (SELECT *, first_value(close) OVER (PARTITION BY code ORDER BY dt) AS f FROM l2panel) b JOIN l2adj m ON m.code = b.code AND m.i = b.i""")
_near = "OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN"
cte("l2pk", f"""SELECT *, CASE WHEN i > 5 AND count(close) {_near} 1 FOLLOWING AND 5 FOLLOWING) = 5 AND close > max(close) {_near} 5 PRECEDING AND 1 PRECEDING) AND close > max(close) {_near} 1 FOLLOWING AND 5 FOLLOWING) THEN i END AS pi FROM l2dif""")
cte("l2dvg", f"""SELECT q.*, coalesce(len(l) >= 2 AND a.close > b.close AND a.dif <= b.dif, false) AS dvg FROM (SELECT *, list(pi) FILTER (pi IS NOT NULL) {_near} 54 PRECEDING AND 5 PRECEDING) AS l FROM l2pk) q
  LEFT JOIN l2dif a ON a.code = q.code AND a.i = q.l[-1] LEFT JOIN l2dif b ON b.code = q.code AND b.i = q.l[-2]""")
cte("zrsi", f"""SELECT code, dt, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) END AS rsi FROM (SELECT code, dt, {rolled('avg', 'l', 14, 14)} AS al, {rolled('avg', 'g', 14, 14)} AS ag FROM (SELECT *, CASE WHEN pre_close IS NOT NULL THEN greatest(close - pre_close, 0) END AS g,
  CASE WHEN pre_close IS NOT NULL THEN greatest(pre_close - close, 0) END AS l FROM l2panel))""")
cte("zr", f"""SELECT code, dt, dvg, CASE WHEN rsi > 50 AND dif > 0 AND (vratio IS NULL OR vratio >= 0.8) THEN 'chase' WHEN dif > 0 OR rsi > 45 THEN 'watch' WHEN rsi > 55 THEN 'top_warn' WHEN rsi < 30 THEN 'top_warn' ELSE 'weak' END AS zone FROM (
  SELECT z.code, z.dt, z.i, z.dvg, z.dif, x.rsi, z.vol / nullif(CASE WHEN count(z.vol) OVER w >= 20 THEN avg(z.vol) OVER w END, 0) AS vratio FROM l2dvg z JOIN zrsi x ON x.code = z.code AND x.dt = z.dt WINDOW w AS (PARTITION BY z.code ORDER BY z.dt ROWS 19 PRECEDING)) WHERE i >= 60""")


@query(with_ctes("""SELECT dt, count(*) FILTER (zone = 'chase') AS chase, count(*) FILTER (zone = 'watch') AS watch, count(*) FILTER (zone = 'top_warn') AS top_warn,
  count(*) FILTER (zone = 'weak') AS weak, count(*) FILTER (dvg) AS divergence, CASE WHEN count(*) FILTER (dvg) >= 4 THEN 'critical' WHEN count(*) FILTER (zone = 'top_warn') >= 16 THEN 'high' ELSE 'normal' END AS risk_level
  FROM zr GROUP BY dt""", recursive=True))
def zone_rule_counts(spark, base):
    return ops.zone_counts(ops.study_zones(src.l2_bars(spark, base)))


@query(with_ctes(f"""SELECT b.code, b.dt, {rsel({'ema12': adjusted_sql('m.ef', 'b.f', 'b.i', 12), 'ema26': adjusted_sql('m.es', 'b.f', 'b.i', 26)})}
  FROM (SELECT *, first_value(close) OVER (PARTITION BY code ORDER BY dt) AS f FROM panel) b JOIN macd1 m ON m.code = b.code AND m.i = b.i""", recursive=True))
def ewm_adjusted(spark, base):
    d = with_ewm_adjusted(src.instrument_bars(spark, base), {"ema12": ("close", span_rate(12)), "ema26": ("close", span_rate(26))})
    return shown(d, ["ema12", "ema26"])


@query(with_ctes(f"SELECT code, dt, dvg AS peak_divergence, {r('dif')} AS macd_dif FROM l2dvg WHERE i >= 60", recursive=True))
def study_divergence(spark, base):
    d = ops.study_zones(src.l2_bars(spark, base))
    return d.select("code", "dt", F.col("divergence").alias("peak_divergence"), rd("macd_dif").alias("macd_dif"))


cte("l3bars", f"""SELECT l2 * 10 + code % 3 AS l3, dt, {BAR} FROM ticks JOIN members USING (code) GROUP BY 1, 2""")
cte("hlev", f"""SELECT code, dt, level, m - g AS excess, g - lag(g) OVER (PARTITION BY code, dt ORDER BY level) AS dv, sum(CASE WHEN sign(g) = sign(m) AND sign(m) <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code, dt) AS agree FROM (
  SELECT p.code, p.dt, v.level, p.m, coalesce(CASE v.level WHEN 1 THEN a.h WHEN 2 THEN b.h ELSE c.h END, 0) AS g FROM (SELECT code, dt, coalesce((close / lag(close, 20) {W} - 1) * 100, 0) AS m FROM panel) p JOIN members g ON g.code = p.code
  JOIN (SELECT unnest([1, 2, 3]) AS level) v ON true LEFT JOIN (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS h FROM l1panel) a ON a.code = g.l1 AND a.dt = p.dt
  LEFT JOIN (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS h FROM l2panel) b ON b.code = g.l2 AND b.dt = p.dt
  LEFT JOIN (SELECT l3, dt, (close / lag(close, 20) OVER (PARTITION BY l3 ORDER BY dt) - 1) * 100 AS h FROM l3bars) c ON c.l3 = g.l2 * 10 + g.code % 3 AND c.dt = p.dt)""")


def three_levels(spark, base):
    """Members with a third level below the nations, and its bars."""
    members = src.members(spark, base).withColumn("l3", F.col("l2") * 10 + F.col("code") % 3)
    t = src.trade_ticks(spark, base).join(members.select("code", "l3"), "code").drop("code").withColumnRenamed("l3", "code")
    return members, src.build_bars(t, ["code", "dt"], "px", "qty", "amt", src.tick_order())


@query(with_ctes(f"SELECT code, dt, CAST(level AS INTEGER) AS level, {rsel({'excess_return': 'excess', 'divergence': 'dv'})}, CAST(agree AS BIGINT) AS agreeing FROM hlev"))
def industry_hierarchy_levels(spark, base):
    members, l3 = three_levels(spark, base)
    name = lambda level, c: F.concat(F.lit(f"{level}:"), c)
    edges = members.select(name("l3", "l3").alias("child"), name("l2", "l2").alias("parent")).unionByName(members.select(name("l2", "l2").alias("child"), name("l1", "l1").alias("parent"))).distinct()
    tree = ops.closure(edges, members.select("code", name("l3", "l3").alias("parent")))
    l1, l2 = src.l1_bars(spark, base), src.l2_bars(spark, base)
    bars = [b.select(name(level, "code").alias("code"), "dt", "close") for level, b in (("l1", l1), ("l2", l2), ("l3", l3))]
    f = ind.momenta(src.instrument_bars(spark, base), (20,)).select("code", "dt", "mom20")
    d = ops.hierarchy_levels(f, tree, bars[0].unionByName(bars[1]).unionByName(bars[2]), mkt.market_index(l1))
    return d.select("code", "dt", "level", rd("excess_return").alias("excess_return"), rd("divergence").alias("divergence"), "agreeing")


cte("hier", f"""SELECT p.code, p.dt, p.m, coalesce(a.h, 0) AS h1, coalesce(b.h, 0) AS h2 FROM (SELECT code, dt, coalesce((close / lag(close, 20) {W} - 1) * 100, 0) AS m FROM panel) p
  JOIN members g ON g.code = p.code LEFT JOIN (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS h FROM l1panel) a ON a.code = g.l1 AND a.dt = p.dt
  LEFT JOIN (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS h FROM l2panel) b ON b.code = g.l2 AND b.dt = p.dt""")


@query(with_ctes(f"""SELECT code, dt, {rsel({'excess_return_l1': 'm - h1', 'excess_return_l2': 'm - h2', 'L2_L1_divergence': 'h2 - h1',
  'industry_cascade': 'CASE WHEN m = 0 THEN 2 ELSE 1 + CASE WHEN sign(h2) = sign(m) THEN 1 ELSE 0 END + CASE WHEN sign(h1) = sign(m) THEN 1 ELSE 0 END END'})} FROM hier"""))
def industry_hierarchy(spark, base):
    f = ind.momenta(src.instrument_bars(spark, base), (20,)).select("code", "dt", "mom20")
    d = ops.hierarchy_features(f, src.members(spark, base), src.l1_bars(spark, base), src.l2_bars(spark, base), mkt.market_index(src.l1_bars(spark, base)))
    return shown(d, ["excess_return_l1", "excess_return_l2", "L2_L1_divergence", "industry_cascade"])

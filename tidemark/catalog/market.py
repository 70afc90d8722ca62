"""Date-level market series."""

from pyspark.sql import functions as F

from ..functions.scalar import rd
from ..operators import cross, market as mkt
from ..sources import bars as src
from .ctes import EXACT, cte, mean, r, whole, with_ctes
from .registry import query
from .windows import rsel, shown, walk

D = "OVER (ORDER BY dt)"


def d_over(n):
    return f"OVER (ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def d_full(fn, x, n):
    return f"CASE WHEN count({x}) {d_over(n)} >= {n} THEN {fn}({x}) {d_over(n)} END"


cte("mkt", """SELECT dt, avg(close) AS close, avg(high) AS high, avg(low) AS low, sum(vol) AS vol, sum(amount) AS amount, count(*) AS n_members,
  row_number() OVER (ORDER BY dt) AS i FROM l1bars GROUP BY dt""")


@query(with_ctes(f"SELECT dt, {rsel({'close': 'close', 'high': 'high', 'low': 'low'})}, n_members FROM mkt"))
def market_index(spark, base):
    d = mkt.market_index(src.l1_bars(spark, base))
    return d.select("dt", rd("close").alias("close"), rd("high").alias("high"), rd("low").alias("low"), "n_members")


@query(with_ctes(f"""SELECT dt, {r('ret', 6)} AS ret, {r("ln(exp(s - first_value(s) OVER (ORDER BY dt)) * 1000)", 6)} AS log_index FROM (
  SELECT dt, ret, sum(ln(1 + ret)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT dt, coalesce(avg(pct_chg) / 100, 0) AS ret FROM l2panel GROUP BY dt))"""))
def market_return_index(spark, base):
    d = mkt.market_return_index(src.with_change(src.l2_bars(spark, base)))
    return d.select("dt", rd("ret", 6).alias("ret"), rd(F.log("index_close"), 6).alias("log_index"))


cte("l2breadth", "SELECT dt, count(*) FILTER (pct_chg < 0) / count(*)::DOUBLE * 100 AS down_pct, count(*) AS n_members FROM l2panel GROUP BY dt")


@query(with_ctes(f"SELECT dt, {r('down_pct')} AS down_pct, n_members FROM l2breadth"))
def breadth_down(spark, base):
    d = mkt.breadth(src.with_change(src.l2_bars(spark, base)))
    return d.select("dt", rd("down_pct").alias("down_pct"), "n_members")


@query(with_ctes(f"""SELECT dt, {rsel({'advance_decline_ratio': 'CASE WHEN dn > 0 THEN up / dn::DOUBLE ELSE 0 END', 'total_up_days': 'up',
  'market_extreme_signal': 'CASE WHEN up > n * 0.8 OR dn > n * 0.8 THEN 1 ELSE 0 END', 'market_regime_score': 'coalesce(m, 0)', 'bull_bear_power': 'bb'})}
  FROM (SELECT dt, count(*) FILTER (pct_chg > 0) AS up, count(*) FILTER (pct_chg < 0) AS dn, count(*) AS n, avg(pct_chg) AS m,
  count(*) FILTER (pct_chg > 2) - count(*) FILTER (pct_chg < -2) AS bb FROM panel GROUP BY dt)"""))
def breadth_features(spark, base):
    d = mkt.breadth_features(src.instrument_panel(spark, base))
    return shown(d, ["advance_decline_ratio", "total_up_days", "market_extreme_signal", "market_regime_score", "bull_bear_power"], keys=("dt",))


cte("tov", """SELECT p.dt, p.amount / v.total_mv * 100 AS turnover, v.total_mv, p.amount, v.pe_ttm FROM panel p
  JOIN valuation v ON p.code = v.code AND v.dt = CAST(date_trunc('month', p.dt) AS DATE)""")
cte("tovd", """SELECT dt, avg(turnover) AS avg_turnover, median(turnover) AS median_turnover, median(pe_ttm) AS median_pe,
  sum(total_mv) AS total_mv, sum(amount) AS total_amount, count(*) AS n_codes FROM tov GROUP BY dt""")


@query(with_ctes(f"""SELECT dt, {rsel({'avg_turnover': 'avg_turnover', 'median_turnover': 'median_turnover', 'median_pe': 'median_pe'})},
  {rsel({'total_mv': 'total_mv', 'total_amount': 'total_amount'}, 2)}, n_codes FROM tovd"""))
def market_turnover(spark, base):
    d = mkt.turnover(src.instrument_bars(spark, base), src.valuation(spark, base))
    return d.select("dt", *[rd(c).alias(c) for c in ("avg_turnover", "median_turnover", "median_pe")],
                    rd("total_mv", 2).alias("total_mv"), rd("total_amount", 2).alias("total_amount"), "n_codes")


cte("mgd", """SELECT *, (rzye - lag(rzye, 1) OVER (ORDER BY dt)) / nullif(abs(lag(rzye, 1) OVER (ORDER BY dt)), 0) * 100 AS chg1,
  (rzye - lag(rzye, 3) OVER (ORDER BY dt)) / nullif(abs(lag(rzye, 3) OVER (ORDER BY dt)), 0) * 100 AS chg3
  FROM (SELECT dt, sum(rzye) AS rzye, sum(rzmre) AS rzmre, sum(rzche) AS rzche FROM margin GROUP BY dt)""")


@query(with_ctes(f"SELECT dt, {rsel({'rzye': 'rzye', 'rzmre': 'rzmre', 'rzche': 'rzche', 'net_buy': 'rzmre - rzche'}, 2)}, {rsel({'rzye_chg_1d': 'chg1', 'rzye_chg_3d': 'chg3'}, 3)} FROM mgd"))
def margin_totals(spark, base):
    d = mkt.margin_totals(src.margin(spark, base))
    return d.select("dt", *[rd(c, 2).alias(c) for c in ("rzye", "rzmre", "rzche", "net_buy")], rd("rzye_chg_1d", 3).alias("rzye_chg_1d"), rd("rzye_chg_3d", 3).alias("rzye_chg_3d"))


@query(with_ctes(f"""SELECT dt, {r('rzye_chg_3d', 3)} AS rzye_chg_3d, {r('pct')} AS pct FROM (SELECT dt, chg3 AS rzye_chg_3d,
  CASE WHEN chg3 IS NOT NULL THEN cume_dist() OVER (PARTITION BY chg3 IS NULL ORDER BY chg3) * 100 END AS pct FROM mgd)"""))
def history_percentile(spark, base):
    d = mkt.history_percentile(mkt.margin_totals(src.margin(spark, base)), "rzye_chg_3d", "pct")
    return d.select("dt", rd("rzye_chg_3d", 3).alias("rzye_chg_3d"), rd("pct").alias("pct"))


EXACT_MARKET = {
    "tovd": f"SELECT dt, {mean('turnover')} AS avg_turnover FROM tov GROUP BY dt",
    "mgd": f"""SELECT dt, (rzye - lag(rzye, 3) OVER (ORDER BY dt)) / nullif(abs(lag(rzye, 3) OVER (ORDER BY dt)), 0) * 100 AS chg3
  FROM (SELECT dt, {whole('rzye')} AS rzye FROM margin GROUP BY dt)""",
}
cte("moodq", """SELECT dt, chg3, avg_turnover, round(coalesce(lp, 50)) AS lp, round(coalesce(tp, 50)) AS tp FROM
  (SELECT dt, chg3, CASE WHEN chg3 IS NOT NULL THEN cume_dist() OVER (PARTITION BY chg3 IS NULL ORDER BY chg3) * 100 END AS lp FROM mgd)
  FULL JOIN (SELECT dt, avg_turnover, cume_dist() OVER (ORDER BY avg_turnover) * 100 AS tp FROM tovd) USING (dt)""")


@query(with_ctes(f"""SELECT dt, lp AS leverage_pct, tp AS turnover_pct,
  CASE WHEN chg3 < -1 THEN 'deleveraging' WHEN chg3 > 1 THEN 'leveraging' WHEN chg3 IS NOT NULL THEN 'steady' ELSE 'unknown' END AS leverage_signal,
  CASE WHEN tp >= 80 THEN 'high' WHEN tp <= 20 THEN 'low' ELSE 'normal' END AS turnover_signal,
  CASE WHEN lp >= 90 AND tp >= 90 THEN 'extreme' WHEN lp >= 90 OR tp >= 90 THEN 'elevated' WHEN lp <= 20 AND tp <= 20 THEN 'cold' ELSE 'normal' END AS mood
  FROM moodq""", EXACT | EXACT_MARKET))
def market_sentiment(spark, base):
    d = mkt.sentiment(mkt.margin_totals(src.margin(spark, base)), mkt.turnover(src.instrument_bars(spark, base), src.valuation(spark, base)))
    return d.select("dt", "leverage_pct", "turnover_pct", "leverage_signal", "turnover_signal", "mood")


cte("mkdm", """SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM (
  SELECT 'M' AS code, dt, i, close, CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (ORDER BY dt)), abs(low - lag(close) OVER (ORDER BY dt))) END AS tr,
  high - lag(high) OVER (ORDER BY dt) AS up, lag(low) OVER (ORDER BY dt) - low AS dn FROM mkt)""")
walk("mkdmw", "mkdm", ["t", "p", "m"], {"t": "tr", "p": "p::DOUBLE", "m": "m::DOUBLE"},
     {"t": "r.t * (1 - 1 / 14.0) + b.tr / 14.0", "p": "r.p * (1 - 1 / 14.0) + b.p / 14.0", "m": "r.m * (1 - 1 / 14.0) + b.m / 14.0"}, [])
cte("mkdx", """SELECT code, dt, row_number() OVER (ORDER BY dt) AS i, 100 * abs(pd - md) / (pd + md + 1e-10) AS dx FROM (
  SELECT b.code, b.dt, 100 * w.p / nullif(w.t, 0) AS pd, 100 * w.m / nullif(w.t, 0) AS md FROM mkdm b JOIN mkdmw w ON b.i = w.i) WHERE pd IS NOT NULL""")
walk("mkadx", "mkdx", ["a"], {"a": "dx"}, {"a": "r.a * (1 - 1 / 14.0) + b.dx / 14.0"}, [])
cte("regq", f"""SELECT dt, close, i, {d_full('avg', 'close', 50)} AS ma50, {d_full('avg', 'close', 200)} AS ma200, {d_full('avg', 'close', 20)} AS ma20,
  coalesce((close / lag(close, 20) {D} - 1) * 100, 0) AS ret20, coalesce((close / lag(close, 60) {D} - 1) * 100, 0) AS ret60, x.adx
  FROM mkt k LEFT JOIN (SELECT d.dt AS xdt, w.a AS adx FROM mkdx d JOIN mkadx w ON d.i = w.i) x ON xdt = k.dt""")
cte("regq2", """SELECT *, CASE WHEN i <= 200 THEN 'RANGE' WHEN adx >= 25 AND close > ma200 THEN 'BULL' WHEN adx >= 25 THEN 'BEAR' ELSE 'RANGE' END AS regime FROM regq""")
cte("regq3", """SELECT *, CASE WHEN i <= 200 THEN NULL WHEN regime = 'BEAR' AND ret20 < -5 THEN 'bear' WHEN regime = 'BULL' AND ret20 > 5 AND ret60 > 10 THEN 'bull'
  WHEN regime = 'BULL' AND ret20 > 3 THEN 'early_bull' WHEN close > ma20 AND ret20 > 2 THEN 'rebound' WHEN close > ma20 THEN 'range_up'
  WHEN close > ma200 THEN 'pullback' ELSE 'range_down' END AS regime_v2 FROM regq2""")


@query(with_ctes(f"SELECT dt, {rsel({'price': 'close', 'ma50': 'ma50', 'ma200': 'ma200', 'adx': 'adx'}, 3)}, regime, regime_v2 FROM regq3", recursive=True))
def regime(spark, base):
    d = mkt.regimes(mkt.market_index(src.l1_bars(spark, base)))
    return d.select("dt", *[rd(c, 3).alias(c) for c in ("price", "ma50", "ma200", "adx")], "regime", "regime_v2")


@query(with_ctes("""SELECT dt, regime_v2, CASE WHEN regime_v2 IN ('bull', 'early_bull') THEN 'bull' WHEN regime_v2 = 'bear' THEN 'bear' ELSE 'range' END AS regime3 FROM regq3""", recursive=True))
def regime_normalised(spark, base):
    d = mkt.regimes(mkt.market_index(src.l1_bars(spark, base)))
    return d.select("dt", "regime_v2", mkt.normalised_regime(F.coalesce("regime_v2", F.lit(""))).alias("regime3"))


cte("upq", "SELECT 'M' AS code, dt, i, close, CASE WHEN close > lag(close) OVER (ORDER BY dt) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM mkt")
walk("upw", "upq", ["a", "z"], {"a": "up", "z": "up"}, {"a": "r.a + (b.up - r.a) * 2 / 15.0", "z": "r.z + ((r.a + (b.up - r.a) * 2 / 15.0) - r.z) * 2 / 15.0"}, [])
cte("upreg", f"""SELECT dt, close, up_ema, ma200, CASE WHEN up_ema >= 25 AND coalesce(close > ma200, true) THEN 'BULL' WHEN up_ema >= 25 THEN 'BEAR' ELSE 'RANGE' END AS regime
  FROM (SELECT b.dt, b.close, w.z * 100 AS up_ema, CASE WHEN count(b.close) {d_over(200).replace('dt', 'b.dt')} >= 120 THEN avg(b.close) {d_over(200).replace('dt', 'b.dt')} END AS ma200
  FROM upq b JOIN upw w ON b.i = w.i)""")


@query(with_ctes(f"SELECT dt, {rsel({'ma200': 'ma200', 'up_ema': 'up_ema'}, 3)}, regime FROM upreg", recursive=True))
def regime_up_share(spark, base):
    d = mkt.up_ema_regimes(mkt.market_index(src.l1_bars(spark, base)))
    return d.select("dt", rd("ma200", 3).alias("ma200"), rd("up_ema", 3).alias("up_ema"), "regime")


@query(with_ctes(f"""SELECT k.dt, {rsel({'index_close': 'k.close', 'chg5': 'c5', 'chg20': 'c20', 'chg60': 'c60'})}, k.close > m200 AS above_ma200,
  {rsel({'above_ma20_pct': 'a', 'up_5d_pct': 'u'})} FROM (SELECT dt, close, (close / lag(close, 5) {D} - 1) * 100 AS c5, (close / lag(close, 20) {D} - 1) * 100 AS c20,
  (close / lag(close, 60) {D} - 1) * 100 AS c60, {d_full('avg', 'close', 200)} AS m200 FROM mkt) k LEFT JOIN (
  SELECT dt, count(*) FILTER (close > m) * 100.0::DOUBLE / nullif(count(m), 0) AS a, count(*) FILTER (m5 > 0) * 100.0::DOUBLE / nullif(count(m5), 0) AS u FROM (
    SELECT dt, close, CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY code ORDER BY dt ROWS 19 PRECEDING) END AS m,
    close / lag(close, 5) OVER (PARTITION BY code ORDER BY dt) - 1 AS m5 FROM l2panel) GROUP BY dt) s ON s.dt = k.dt"""))
def market_dashboard(spark, base):
    d = mkt.dashboard(mkt.market_index(src.l1_bars(spark, base)), src.l2_bars(spark, base))
    return d.select("dt", *[rd(c).alias(c) for c in ("index_close", "chg5", "chg20", "chg60")], "above_ma200",
                    rd("above_ma20_pct").alias("above_ma20_pct"), rd("up_5d_pct").alias("up_5d_pct"))


@query(with_ctes(f"""SELECT dt, code, {r('pct_chg')} AS pct_chg, CAST(rk AS INTEGER) AS rk, side FROM (
  SELECT dt, code, pct_chg, row_number() OVER (PARTITION BY dt ORDER BY pct_chg DESC, code) AS rk, 'top' AS side FROM l2panel WHERE pct_chg IS NOT NULL
  UNION ALL SELECT dt, code, pct_chg, row_number() OVER (PARTITION BY dt ORDER BY pct_chg, code), 'bottom' FROM l2panel WHERE pct_chg IS NOT NULL) WHERE rk <= 3"""))
def top_bottom_sectors(spark, base):
    d = mkt.extremes_by_date(src.with_change(src.l2_bars(spark, base)))
    return d.select("dt", "code", rd("pct_chg").alias("pct_chg"), "rk", "side")


cte("codeamt", "SELECT code, avg(amount) AS avg_amount FROM panel GROUP BY code")
cte("sizes", """SELECT code, avg_amount, CASE WHEN avg_amount <= q1 THEN 'micro' WHEN avg_amount <= q2 THEN 'mid' ELSE 'large' END AS size_group
  FROM codeamt, (SELECT quantile_cont(avg_amount, 1 / 3.0) AS q1, quantile_cont(avg_amount, 2 / 3.0) AS q2 FROM codeamt)""")
cte("microbreadth", """SELECT dt, count(*) FILTER (pct_chg < 0) / count(*)::DOUBLE * 100 AS down_pct FROM panel
  WHERE code IN (SELECT code FROM sizes WHERE size_group = 'micro') GROUP BY dt""")


@query(with_ctes(f"SELECT code, {r('avg_amount', 2)} AS avg_amount, size_group FROM sizes"))
def size_group(spark, base):
    return cross.size_groups(src.instrument_bars(spark, base)).select("code", rd("avg_amount", 2).alias("avg_amount"), "size_group")


cte("fragq", f"""SELECT *, count(*) {d_over(5)} >= 5 AS full5, count(*) FILTER (down_pct > 70) {d_over(5)} AS heavy,
  count(*) FILTER (down_pct > 75) {d_over(5)} AS strict, count(*) FILTER (micro_down > 70) {d_over(5)} AS mic FROM (
  SELECT k.dt, k.close, k.chg, k.vol, k.ma20, k.vma20, b.down_pct, m.down_pct AS micro_down FROM (
    SELECT dt, close, vol, (close / lag(close) {D} - 1) * 100 AS chg, {d_full('avg', 'close', 20)} AS ma20, {d_full('avg', 'vol', 20)} AS vma20 FROM mkt) k
  JOIN l2breadth b ON b.dt = k.dt LEFT JOIN microbreadth m ON m.dt = k.dt)""")
cte("fragq2", """SELECT *, coalesce(full5 AND heavy >= 3, false) AS p1, coalesce(full5 AND strict >= 4, false) AS p1s, coalesce(close < ma20, false) AS p2,
  coalesce(chg > 0 AND down_pct > 60 AND vol < vma20, false) AS p3, coalesce(full5 AND mic >= 3, false) AS mp FROM fragq""")


@query(with_ctes(f"""SELECT dt, {r('down_pct')} AS down_pct, heavy AS heavy_days, p1, p1s AS p1_strict, p2, p3, mp AS micro_p1,
  CASE WHEN p1s AND mp THEN 'danger' WHEN p1s OR (p1 AND p2) THEN 'danger' WHEN p1 AND mp THEN 'danger' WHEN p1 OR (p2 AND p3) THEN 'warning' WHEN p3 OR mp THEN 'caution' ELSE 'normal' END AS alert_level,
  CASE WHEN p1s OR (p1 AND p2) OR (p1 AND mp) THEN 15 WHEN p1 OR (p2 AND p3) THEN 30 WHEN p3 OR mp THEN 40 ELSE 100 END AS pos_cap, down_pct <= 30 AS re_entry FROM fragq2"""))
def fragility(spark, base):
    panel = src.instrument_panel(spark, base)
    micro = cross.size_groups(panel).where("size_group = 'micro'")
    d = mkt.fragility(mkt.market_index(src.l1_bars(spark, base)), mkt.breadth(src.with_change(src.l2_bars(spark, base))),
                      mkt.breadth(panel.join(micro, "code", "left_semi")))
    return d.withColumn("down_pct", rd("down_pct"))


cte("rskq", f"""SELECT k.dt, k.close, k.i, stddev_samp(ret) {d_over(5)} AS s5, stddev_samp(ret) {d_over(20)} AS s20, k.amount, {d_full('avg', 'amount', 20)} AS a20,
  {d_full('avg', 'close', 20)} AS ma20 FROM (SELECT *, close / lag(close) {D} - 1 AS ret FROM mkt) k""")
cte("rsksec", f"""SELECT dt, count(*) FILTER (pct_chg > 0)::DOUBLE / nullif(count(pct_chg), 0) AS breadth_ratio, count(*) FILTER (close > m)::DOUBLE / nullif(count(m), 0) AS ma20_ratio,
  median(rsi) AS rsi_median FROM (SELECT *, CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY code ORDER BY dt ROWS 19 PRECEDING) END AS m,
  CASE WHEN i > 14 AND avg(l) OVER (PARTITION BY code ORDER BY dt ROWS 13 PRECEDING) > 0 THEN 100 - 100 / (1 + avg(g) OVER (PARTITION BY code ORDER BY dt ROWS 13 PRECEDING) / avg(l) OVER (PARTITION BY code ORDER BY dt ROWS 13 PRECEDING)) END AS rsi
  FROM (SELECT *, greatest(close - pre_close, 0) AS g, greatest(pre_close - close, 0) AS l FROM l2panel)) GROUP BY dt""")
cte("rskall", """SELECT q.dt, q.close, b.breadth_ratio, b.ma20_ratio, CASE WHEN i > 20 THEN s5 / nullif(s20, 0) END AS vol_expansion, amount / nullif(a20, 0) AS volume_shock,
  (close / ma20 - 1) * 100 AS index_deviation, b.rsi_median FROM rskq q LEFT JOIN rsksec b USING (dt)""")
RISK = ["breadth_ratio", "ma20_ratio", "vol_expansion", "volume_shock", "index_deviation", "rsi_median"]


@query(with_ctes(f"SELECT dt, {rsel({k: k for k in RISK})} FROM rskall"))
def risk_features(spark, base):
    return shown(mkt.risk_features(mkt.market_index(src.l1_bars(spark, base)), src.l2_bars(spark, base)), RISK, keys=("dt",))


RISK_WEIGHTS = {"breadth_ratio": -0.2, "ma20_ratio": -0.2, "vol_expansion": 0.2, "volume_shock": 0.15, "index_deviation": 0.15, "rsi_median": 0.1}


def _risk_score_sql():
    terms = " + ".join(f"coalesce(({k} - min({k}) OVER ()) / nullif(max({k}) OVER () - min({k}) OVER (), 0), 0) * ({w})" for k, w in RISK_WEIGHTS.items())
    return f"SELECT dt, close, {terms} AS score FROM rskall"


cte("risksc", _risk_score_sql())


@query(with_ctes(f"SELECT dt, {r('score')} AS score FROM risksc"))
def risk_composite_score(spark, base):
    d = mkt.risk_features(mkt.market_index(src.l1_bars(spark, base)), src.l2_bars(spark, base))
    return shown(mkt.minmax_score(d, RISK_WEIGHTS), ["score"], keys=("dt",))


cte("warnq", f"""SELECT *, row_number() {D} - 1 AS j, count(*) {d_over(5)} >= 5 AND count(*) FILTER (down_pct > 70) {d_over(5)} >= 3 AS collapse FROM (
  SELECT k.*, b.down_pct FROM (SELECT dt, close, (close / lag(close) {D} - 1) * 100 AS chg, (close / lag(close, 5) {D} - 1) * 100 AS ret5, (close / lag(close, 10) {D} - 1) * 100 AS ret10,
  coalesce(close < {d_full('avg', 'close', 20)}, false) AS below, coalesce(vol < {d_full('avg', 'vol', 20)}, false) AS thin FROM mkt) k JOIN l2breadth b USING (dt))""")
cte("warns", f"""SELECT *, j >= 5 AND collapse AND NOT coalesce(lag(collapse) {D}, false) AS phase1, j >= 20 AND below AND NOT coalesce(lag(below) {D}, false) AS phase2,
  coalesce(chg > 0 AND down_pct > 60 AND thin, false) AS phase3 FROM warnq""")


@query(with_ctes(f"""SELECT dt, {r('down_pct')} AS down_pct, phase1, phase2, phase3, CASE WHEN phase3 THEN 'danger' WHEN phase2 THEN 'warning' WHEN phase1 THEN 'caution' ELSE 'normal' END AS alert_level FROM warns"""))
def warning_phases(spark, base):
    d = mkt.warning_signals(mkt.market_index(src.l1_bars(spark, base)), mkt.breadth(src.with_change(src.l2_bars(spark, base))))
    return d.select("dt", rd("down_pct").alias("down_pct"), "phase1", "phase2", "phase3", "alert_level")


@query(with_ctes(f"""SELECT dt, {rsel({'idx5': 'c5', 'idx20': 'c20', 'breadth': '100 - down_pct'})} FROM (SELECT dt, (close / lag(close, 5) {D} - 1) * 100 AS c5, (close / lag(close, 20) {D} - 1) * 100 AS c20 FROM mkt)
  JOIN l2breadth USING (dt) WHERE c20 >= 2"""))
def market_filter(spark, base):
    d = mkt.market_allows(mkt.market_index(src.l1_bars(spark, base)), mkt.breadth(src.with_change(src.l2_bars(spark, base))), "idx20", 2.0)
    return shown(d, ["idx5", "idx20", "breadth"], keys=("dt",))


@query(with_ctes(f"""SELECT dt, {r('close')} AS close, {r('CASE WHEN len(h) >= 60 THEN len([v FOR v IN h IF v <= close]) / len(h)::DOUBLE * 100 END')} AS ts_pct FROM (
  SELECT dt, close, list(close) {d_over(250)} AS h FROM mkt)"""))
def trailing_percentile(spark, base):
    d = mkt.ts_percentile(mkt.market_index(src.l1_bars(spark, base)), "close", "ts_pct", key="code")
    return shown(d, ["close", "ts_pct"], keys=("dt",))

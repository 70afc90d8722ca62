"""Rolling indicators per instrument."""

from pyspark.sql import functions as F

from ..functions.scalar import rd
from ..operators import indicators as ind
from ..sources import bars as src
from .ctes import W, cte, over, r, rolled, with_ctes
from .registry import query

ROWS = "ROWS BETWEEN"


def shown(df, cols, digits=4, keys=("code", "dt")):
    return df.select(*keys, *[rd(c, digits).alias(c) for c in cols])


def rsel(pairs, digits=4):
    """SELECT list of rounded expressions from {name: expression}."""
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in pairs.items())


MOM = (1, 2, 3, 4, 5, 7, 10, 12, 15, 20, 30, 45, 60, 75, 90, 120)


@query(with_ctes(f"SELECT code, dt, {rsel({f'mom{n}': f'(close / lag(close, {n}) {W} - 1) * 100' for n in MOM})} FROM panel"))
def momentum(spark, base):
    d = ind.momenta(src.instrument_bars(spark, base))
    return shown(d, [f"mom{n}" for n in MOM])


MAS = (5, 10, 20, 60, 120, 250)
cte("mas", f"SELECT *, {', '.join(f'avg(close) {over(n)} AS ma{n}' for n in MAS)} FROM panel")


@query(with_ctes(f"""SELECT code, dt, {rsel({f'ma{n}_dev': f'(close / ma{n} - 1) * 100' for n in MAS})},
  (CASE WHEN ma5 > ma20 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ma_cross,
  least(greatest(sign(ma5 - ma10) + sign(ma10 - ma20) + sign(ma20 - ma60) + 2, 0), 4)::DOUBLE AS ma_arrangement,
  {r('(ma5 - ma20) / close * 100')} AS ma_gap FROM mas"""))
def moving_average(spark, base):
    d = ind.ma_order(ind.moving_averages(src.instrument_bars(spark, base)))
    return shown(d, [*[f"ma{n}_dev" for n in MAS], "ma_cross", "ma_arrangement", "ma_gap"])


cte("bb", f"SELECT *, {rolled('avg', 'close', 20, 5)} AS m, {rolled('stddev_samp', 'close', 20, 5)} AS s FROM panel")


@query(with_ctes(f"""SELECT code, dt, {rsel({'bb_mid': 'm', 'bb_upper': 'm + 2 * s', 'bb_lower': 'm - 2 * s',
  'bb_pct_b': 'CASE WHEN s > 0 THEN (close - (m - 2 * s)) / (4 * s) * 100 ELSE 50 END',
  'bb_width': 'CASE WHEN m > 0 THEN 2 * s / m * 100 ELSE 0 END'})} FROM bb"""))
def bollinger(spark, base):
    d = ind.bollinger(src.instrument_bars(spark, base))
    return shown(d, ["bb_mid", "bb_upper", "bb_lower", "bb_pct_b", "bb_width"])


cte("bbfull", f"SELECT *, {rolled('avg', 'close', 20, 20)} AS m, {rolled('stddev_samp', 'close', 20, 20)} AS s FROM panel")
cte("bbflags", """SELECT *, 2 * s / m * 100 AS w,
  CASE WHEN close >= m - 2 * s AND close <= m + 2 * s THEN 1.0 ELSE 0.0 END AS ins FROM bbfull""")


@query(with_ctes(f"""SELECT code, dt, (CASE WHEN close > m + 2 * s THEN 1.0 ELSE 0.0 END)::DOUBLE AS bb_cross_upper,
  (CASE WHEN close < m - 2 * s THEN 1.0 ELSE 0.0 END)::DOUBLE AS bb_cross_lower,
  (CASE WHEN w < 0.5 * {rolled('avg', 'w', 60, 60)} THEN 1.0 ELSE 0.0 END)::DOUBLE AS bb_squeeze_flag,
  (sum(ins) {over(5)})::DOUBLE AS inside_bb_days FROM bbflags"""))
def bollinger_events(spark, base):
    d = ind.bollinger_events(src.instrument_bars(spark, base))
    return shown(d, ["bb_cross_upper", "bb_cross_lower", "bb_squeeze_flag", "inside_bb_days"])


cte("vols", f"""SELECT *, avg(vol) {over(5)} AS v5, avg(vol) {over(20)} AS v20, avg(amount) {over(5)} AS a5,
  avg(amount) {over(20)} AS a20, avg(amount) {over(10)} AS a10, {rolled('stddev_samp', 'vol', 20, 5)} AS vs FROM panel""")
cte("vols2", """SELECT *, (v5 - v20) / v20 AS osc, CASE WHEN vol > v20 * 1.5 THEN 1.0 ELSE 0.0 END AS shock FROM vols""")
VOLS = ["vol_ratio", "vol_ma5_ratio", "vol_shock", "volume_oscillator", "amount_ratio", "amount_trend",
        "turnover_ratio_5d_20d", "turnover_std_20d", "amount_ma10_ratio", "vol_shock_count_5d",
        "volume_oscillator_accel", "volume_dry_up_flag"]


@query(with_ctes(f"""SELECT code, dt, {rsel({'vol_ratio': 'vol / v20', 'vol_ma5_ratio': 'vol / v5',
  'vol_shock': f'coalesce(vol / lag(vol) {W}, 1)', 'volume_oscillator': 'osc', 'amount_ratio': 'amount / a20',
  'amount_trend': 'a5 / a20', 'turnover_ratio_5d_20d': 'v5 / v20', 'turnover_std_20d': 'coalesce(vs / v20, 0)',
  'amount_ma10_ratio': 'amount / a10', 'vol_shock_count_5d': f'sum(shock) {over(5)}',
  'volume_oscillator_accel': f'osc - lag(osc) {W}',
  'volume_dry_up_flag': 'CASE WHEN vol < v20 * 0.5 AND osc < -0.3 THEN 1.0 ELSE 0.0 END'})} FROM vols2"""))
def volume_ratio(spark, base):
    return shown(ind.volume_family(src.instrument_bars(spark, base)), VOLS)


@query(with_ctes(f"""SELECT code, dt, vol_spike + 0.0 AS vol_spike, vol_spike > 1.5 AS is_breakout, vol_spike < 0.7 AS is_shrink,
  is_snapshot FROM (SELECT code, dt, round(vol / avg(vol) {over(20)}, 4) AS vol_spike,
  dt = max(dt) OVER (PARTITION BY code) AS is_snapshot FROM panel)"""))
def volume_spike(spark, base):
    d = ind.volume_spike(src.instrument_bars(spark, base))
    return d.select("code", "dt", "vol_spike", "is_breakout", "is_shrink", "is_snapshot")


cte("wtr", """SELECT *, CASE WHEN pre_close IS NULL THEN high - low
  ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END AS tr FROM weekpanel""")


@query(with_ctes(f"""SELECT code, dt, {rsel({'tr': 'tr', 'atr': f'avg(tr) {over(14)}', 'atr14': rolled('avg', 'tr', 14, 14),
  'atr7': rolled('avg', 'tr', 14, 7), 'atr_pct': f'avg(tr) {over(14)} / close * 100'})} FROM wtr"""))
def average_true_range(spark, base):
    d = ind.atr_sma(src.week_bars(spark, base), first_bar_range=True)
    d = d.select("*", ind.mean_n("tr", 14, 14).alias("atr14"), ind.mean_n("tr", 14, 7).alias("atr7"))
    return shown(d, ["tr", "atr", "atr14", "atr7", "atr_pct"])


# Recursions are checked by walking the bars of each code one by one.
def walk(name, src_cte, state, seed, step, cols):
    """Recursive fragment: ``seed``/``step`` give the state columns from row b (and previous row r)."""
    cte(name, f"""SELECT code, i, {', '.join(f'{seed[s]} AS {s}' for s in state)} FROM {src_cte} b WHERE i = 1
  UNION ALL SELECT b.code, b.i, {', '.join(step[s] for s in state)} FROM {name} r JOIN {src_cte} b ON b.code = r.code AND b.i = r.i + 1""")


walk("wilder_tr", "wtr", ["a"], {"a": "tr"}, {"a": "r.a * (1 - 1 / 14.0) + b.tr / 14.0"}, ["tr"])


@query(with_ctes(f"""SELECT b.code, b.dt, {r('w.a')} AS atr_w FROM wtr b JOIN wilder_tr w ON b.code = w.code AND b.i = w.i""", recursive=True))
def average_true_range_wilder(spark, base):
    return shown(ind.atr_wilder(src.week_bars(spark, base)), ["atr_w"])


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close, {r('atr')} AS atr, {r('close - 2 * atr')} AS stop_price,
  {r('atr / close * 100')} AS atr_pct FROM (SELECT b.code, b.dt, b.close, w.a AS atr, max(b.i) OVER (PARTITION BY b.code) AS n, b.i
  FROM wtr b JOIN wilder_tr w ON b.code = w.code AND b.i = w.i) WHERE i = n AND n >= 15""", recursive=True))
def stop_loss_level(spark, base):
    from ..operators.snapshots import latest_rows

    d = latest_rows(ind.atr_wilder(src.week_bars(spark, base)), min_rows=15)
    return d.select("code", "dt", rd("close").alias("close"), rd("atr_w").alias("atr"),
                    rd(F.col("close") - F.col("atr_w") * 2).alias("stop_price"),
                    rd(F.col("atr_w") / F.col("close") * 100).alias("atr_pct"))


cte("rets", "SELECT *, coalesce(pct_chg, 0) AS ret FROM panel")
cte("retwin", f"""SELECT *, count(ret) {over(20)} AS n, avg(ret) {over(20)} AS mu, stddev_samp(ret) {over(20)} AS sd,
  avg(ret) FILTER (ret > 0) {over(20)} AS up, avg(ret) FILTER (ret < 0) {over(20)} AS dn,
  stddev_samp(ret) FILTER (ret < 0) {over(20)} AS dsd, count(*) FILTER (ret < 0) {over(20)} AS nd,
  skewness(ret) {over(20)} AS sk, kurtosis(ret) {over(20)} AS ku, count(*) FILTER (abs(ret) < 0.01) {over(20)} AS nz
  FROM rets""")


@query(with_ctes(f"""SELECT code, dt, {rsel({
  'sharpe_20d': 'CASE WHEN n >= 5 AND sd > 1e-10 THEN mu / sd * sqrt(252) ELSE 0 END',
  'skewness_20d': 'CASE WHEN n >= 5 THEN sk END', 'kurtosis_20d': 'CASE WHEN n >= 5 THEN ku END',
  'downside_vol': 'CASE WHEN n >= 5 THEN CASE WHEN nd > 1 THEN dsd ELSE 0 END END',
  'upside_downside_ratio': 'CASE WHEN n >= 2 AND abs(coalesce(dn, 1)) > 0.01 THEN coalesce(up, 0) / abs(coalesce(dn, 1)) ELSE 0 END',
  'zero_return_days_20d': 'nz'})} FROM retwin"""))
def return_statistics(spark, base):
    d = ind.return_stats(ind.daily_return(src.instrument_bars(spark, base)))
    return shown(d, ["sharpe_20d", "skewness_20d", "kurtosis_20d", "downside_vol", "upside_downside_ratio", "zero_return_days_20d"])


@query(with_ctes(f"""SELECT code, dt, {r('CASE WHEN len(xs) >= 5 THEN list_min([xs[k] / list_max(xs[1:k]) - 1 FOR k IN range(1, len(xs) + 1)]) * 100 END')} AS max_drawdown_20d
  FROM (SELECT code, dt, list(close) {over(20)} AS xs FROM panel)"""))
def rolling_max_drawdown(spark, base):
    d = src.instrument_bars(spark, base).withColumn("max_drawdown_20d", ind.max_drawdown_n())
    return shown(d, ["max_drawdown_20d"])


cte("rv", f"SELECT *, {rolled('stddev_samp', 'pct_chg', 14, 14)} AS v14 FROM panel")
cte("rv2", f"""SELECT *, {rolled('avg', 'v14', 60, 60)} AS m, {rolled('stddev_samp', 'v14', 60, 60)} AS s,
  v14 - lag(v14) {W} AS d1 FROM rv""")


@query(with_ctes(f"""SELECT code, dt, {rsel({'realized_vol_5d': f'stddev_samp(pct_chg) {over(5)}',
  'realized_vol_10d': f'stddev_samp(pct_chg) {over(10)}', 'vol20_annual': rolled('stddev_samp', 'pct_chg', 20, 20) + ' * sqrt(252)',
  'vol_surprise': '(v14 - m) / nullif(s, 0)', 'vol_change_acceleration': f'd1 - lag(d1) {W}',
  'vol_regime_adaptive_ma': 'v14 / nullif(m, 0)'})} FROM rv2"""))
def realised_volatility(spark, base):
    d = ind.realised_vol(src.instrument_panel(spark, base))
    return shown(d, ["realized_vol_5d", "realized_vol_10d", "vol20_annual", "vol_surprise", "vol_change_acceleration", "vol_regime_adaptive_ma"])


def _pos(n):
    lo, hi = f"min(close) {over(n)}", f"max(close) {over(n)}"
    return f"CASE WHEN {hi} > {lo} THEN (close - {lo}) / ({hi} - {lo}) * 100 ELSE 50 END"


@query(with_ctes(f"SELECT code, dt, {rsel({'price_position_20d': _pos(20), 'price_position_60d': _pos(60)})} FROM panel"))
def price_position(spark, base):
    d = src.instrument_bars(spark, base)
    return shown(d.select("*", ind.price_position(20).alias("price_position_20d"), ind.price_position(60).alias("price_position_60d")),
                 ["price_position_20d", "price_position_60d"])


@query(with_ctes(f"""SELECT code, dt, {rsel({
  'vwap_deviation': f'(close / (sum(close * amount) {over(20)} / sum(amount) {over(20)}) - 1) * 100',
  'intraday_vwap_proxy': 'amount / (vol * 100 + 1e-10)', 'close_vs_intraday_ratio': '(close / (amount / (vol * 100 + 1e-10)) - 1) * 100',
  'open_vs_intraday_ratio': '(open / (amount / (vol * 100 + 1e-10)) - 1) * 100'})} FROM panel"""))
def vwap_deviation(spark, base):
    d = ind.vwap(src.instrument_bars(spark, base))
    return shown(d, ["vwap_deviation", "intraday_vwap_proxy", "close_vs_intraday_ratio", "open_vs_intraday_ratio"])


cte("shapes", "SELECT *, (close - open) / nullif(high - low, 0) AS opr FROM weekpanel")


@query(with_ctes(f"""SELECT code, dt, {rsel({'close_position': 'CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END',
  'daily_range': '(high - low) / close * 100', 'gap_pct': 'coalesce(open / pre_close - 1, 0) * 100',
  'high_vs_close_spread': '(high - close) / close * 100', 'low_vs_close_spread': '(low - close) / close * 100',
  'open_position_ratio': 'opr', 'body_to_range_ratio': 'abs(close - open) / nullif(high - low, 0) * 100',
  'open_position_accel': f'opr - lag(opr) {W}'})} FROM shapes"""))
def bar_shape(spark, base):
    d = ind.bar_shape(src.week_bars(spark, base))
    return shown(d, ["close_position", "daily_range", "gap_pct", "high_vs_close_spread", "low_vs_close_spread",
                     "open_position_ratio", "body_to_range_ratio", "open_position_accel"])


cte("cndl", f"""SELECT *, high - low AS rng, abs(close - open) AS body, high - greatest(close, open) AS us, least(close, open) - low AS ls,
  lag(open, 1) {W} AS o1, lag(close, 1) {W} AS c1, lag(open, 2) {W} AS o2, lag(close, 2) {W} AS c2, lag(close, 3) {W} AS c3,
  avg(close) {over(21)} AS a21 FROM weekpanel""")


def _f(cond):
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)::DOUBLE"


@query(with_ctes(f"""SELECT code, dt, {r('CASE WHEN rng > 0 THEN us / rng ELSE 0 END')} AS upper_shadow_ratio,
  {_f('rng > 0 AND body > 0 AND ls >= 2 * body AND us <= body * 0.3')} AS candle_hammer,
  {_f('rng > 0 AND body > 0 AND us >= 2 * body AND ls <= body * 0.3')} AS candle_shooting_star,
  {_f('rng > 0 AND body > 0 AND body / rng < 0.05')} AS candle_doji,
  {_f('rng > 0 AND body > 0 AND c1 < o1 AND close > open AND close >= o1 AND open <= c1')} AS candle_engulfing_bull,
  {_f('rng > 0 AND body > 0 AND c1 > o1 AND close < open AND open >= c1 AND close <= o1')} AS candle_engulfing_bear,
  {_f('rng > 0 AND body > 0 AND c1 <> o1 AND c2 > o2 AND c2 - o2 > a21 * 0.02 AND abs(c1 - o1) < (c2 - o2) * 0.3 AND close < open AND close < c2 - (c2 - o2) * 0.5')} AS candle_evening_star,
  {_f('rng > 0 AND body > 0 AND c2 > o2 AND c1 > o1 AND close > open AND c1 > c2 AND close > c1 AND (c3 IS NULL OR c2 > c3)')} AS candle_three_soldiers,
  {_f('rng > 0 AND body > 0 AND c2 < o2 AND c1 < o1 AND close < open AND c1 < c2 AND close < c1 AND (c3 IS NULL OR c2 < c3)')} AS candle_three_crows,
  {_f('body > 0 AND c3 IS NOT NULL AND c2 > o2 AND open > c2 AND close < o2 + (c2 - o2) * 0.5')} AS candle_dark_cloud,
  {_f('rng > 0 AND ls / rng >= 0.3 AND body / (ls + 1e-10) <= 0.5')} AS candle_long_lower_shadow,
  {_f('rng > 0 AND body / (close + 1e-10) * 100 < 0.1 AND ls / rng >= 0.4')} AS candle_dragonfly FROM cndl"""))
def candle_patterns(spark, base):
    d = ind.candles(src.week_bars(spark, base))
    return shown(d, [c for c in d.columns if c.startswith("candle_") or c == "upper_shadow_ratio"])


cte("gapsq", f"""SELECT code, dt, low, high, lag(high) {W} AS ph, lag(low) {W} AS pl FROM weekpanel""")


@query(with_ctes(f"""SELECT code, dt, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS kind,
  {r('CASE WHEN low > ph THEN low - ph ELSE pl - high END')} AS gap_size,
  {r('(CASE WHEN low > ph THEN low - ph ELSE pl - high END) / ph * 100')} AS gap_pct FROM gapsq WHERE low > ph OR high < pl"""))
def price_gaps(spark, base):
    return ind.find_gaps(src.week_bars(spark, base)).select("code", "dt", "kind", rd("gap_size").alias("gap_size"), rd("gap_pct").alias("gap_pct"))


def _streak_sql():
    c = lambda k: "close" if k == 0 else f"c{k}"
    lags = ", ".join(f"lag(close, {k}) {W} AS c{k}" for k in range(1, 12))
    moves = ", ".join(f"sign({c(k)} - {c(k + 1)})" for k in range(10))
    # the run that counts is the oldest one of equal direction before the first flat day
    hh = " + ".join(f"CASE WHEN c{k} IS NOT NULL AND {c(k - 1)} = greatest({', '.join(c(j) for j in range(k + 1))}) THEN 1 ELSE 0 END" for k in range(1, 11))
    same = ", ".join(f"(({c(k)} / {c(k + 1)} - 1) * 100 >= 0) = ((close / c5 - 1) * 100 >= 0)" for k in range(10))
    return f"""SELECT code, dt,
      (CASE WHEN len(mv) = 0 THEN 0 ELSE mv[-1] * (len(mv) - coalesce(list_max([k FOR k IN range(1, len(mv) + 1) IF mv[k] <> mv[-1]]), 0)) END + 0.0)::DOUBLE AS streak,
      ({hh})::DOUBLE AS higher_high_count,
      (CASE WHEN i > 20 AND abs((close / c5 - 1) * 100) >= 0.01 THEN coalesce(list_position(same, false) - 1, 10) ELSE 0 END)::DOUBLE AS momentum_consistency
    FROM (SELECT *, mv0[1:coalesce(list_position(mv0, 0) - 1, len(mv0))] AS mv FROM (
      SELECT *, [x FOR x IN [{moves}] IF x IS NOT NULL] AS mv0, [{same}] AS same FROM (SELECT *, {lags} FROM panel)))"""


@query(with_ctes(_streak_sql()))
def streaks(spark, base):
    return shown(ind.streaks(src.instrument_bars(spark, base)), ["streak", "higher_high_count", "momentum_consistency"])


@query(with_ctes(f"""SELECT code, dt, CAST(CASE WHEN net_mf_amount > 0 THEN row_number() OVER (PARTITION BY code, grp ORDER BY dt) - lead0 ELSE 0 END AS INTEGER) AS mf_consecutive
  FROM (SELECT *, CASE WHEN grp = 0 THEN 0 ELSE 1 END AS lead0 FROM (SELECT *, sum(CASE WHEN net_mf_amount > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS grp FROM moneyflow))"""))
def consecutive_inflow(spark, base):
    from ..operators.flows import consecutive_inflow as run_length

    return run_length(src.moneyflow(spark, base)).select("code", "dt", "mf_consecutive")


@query(with_ctes(f"""SELECT code, dt, i > 2 AND lead(close, 2) {W} IS NOT NULL AND close = max(close) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
  AND close > lag(close) {W} AND close > lead(close) {W} AS is_peak FROM panel"""))
def local_peaks(spark, base):
    return ind.local_peaks(src.instrument_bars(spark, base)).select("code", "dt", F.coalesce("is_peak", F.lit(False)).alias("is_peak"))


walk("macd1", "panel", ["ef", "es", "sg"], {"ef": "close", "es": "close", "sg": "0.0::DOUBLE"},
     {"ef": "r.ef + (b.close - r.ef) * 2 / 13.0", "es": "r.es + (b.close - r.es) * 2 / 27.0",
      "sg": "r.sg + ((r.ef + (b.close - r.ef) * 2 / 13.0) - (r.es + (b.close - r.es) * 2 / 27.0) - r.sg) * 2 / 10.0"}, ["close"])
cte("macdq", f"""SELECT b.code, b.dt, b.i, b.close, m.ef - m.es AS dif, m.sg AS sig, m.ef - m.es - m.sg AS hist
  FROM panel b JOIN macd1 m ON b.code = m.code AND b.i = m.i""")


@query(with_ctes(f"SELECT code, dt, {rsel({'macd_dif': 'dif', 'macd_signal': 'sig', 'macd_hist': 'hist'})} FROM macdq", recursive=True))
def macd(spark, base):
    return shown(ind.macd(src.instrument_bars(spark, base)), ["macd_dif", "macd_signal", "macd_hist"])


@query(with_ctes(f"""SELECT code, dt, CASE WHEN dif > sig AND d1 <= s1 THEN 'golden_cross' WHEN dif < sig AND d1 >= s1 THEN 'death_cross' ELSE 'neutral' END AS macd_label,
  {_f('dif > sig')} AS macd_cross_long, {r('coalesce(hist - h1, 0)')} AS macd_histogram_accel,
  (count(*) FILTER (dif >= 0 AND d1 < 0) {over(10)})::DOUBLE AS macd_zero_cross
  FROM (SELECT *, lag(dif) {W} AS d1, lag(sig) {W} AS s1, lag(hist) {W} AS h1 FROM macdq WHERE i >= 1)""", recursive=True))
def macd_events(spark, base):
    d = ind.macd_events(ind.macd(src.instrument_bars(spark, base)))
    return d.select("code", "dt", "macd_label", "macd_cross_long", rd("macd_histogram_accel").alias("macd_histogram_accel"), "macd_zero_cross")


cte("gl", """SELECT *, CASE WHEN pre_close IS NOT NULL THEN greatest(close - pre_close, 0) END AS g,
  CASE WHEN pre_close IS NOT NULL THEN greatest(pre_close - close, 0) END AS l FROM panel""")


def _rsi_sql(n):
    g, l = rolled("avg", "g", n, n), rolled("avg", "l", n, n)
    return f"CASE WHEN ({l}) > 0 THEN 100 - 100 / (1 + ({g}) / ({l})) END"


@query(with_ctes(f"SELECT code, dt, {rsel({f'rsi_{n}': _rsi_sql(n) for n in (3, 5, 7, 14, 21, 60)})} FROM gl"))
def rsi(spark, base):
    return shown(ind.rsi_sma(src.instrument_bars(spark, base), (3, 5, 7, 14, 21, 60)), [f"rsi_{n}" for n in (3, 5, 7, 14, 21, 60)])


cte("gl2", "SELECT code, i - 1 AS i, dt, g, l FROM gl WHERE i > 1")
walk("rsiw", "gl2", ["a", "z"], {"a": "g", "z": "l"}, {"a": "r.a * (1 - 1 / 14.0) + b.g / 14.0", "z": "r.z * (1 - 1 / 14.0) + b.l / 14.0"}, [])


@query(with_ctes(f"""SELECT b.code, b.dt, {r('CASE WHEN w.z > 0 THEN 100 - 100 / (1 + w.a / w.z) WHEN w.z = 0 THEN 100 END')} AS rsi_w
  FROM panel b LEFT JOIN rsiw w ON b.code = w.code AND b.i = w.i + 1""", recursive=True))
def rsi_wilder(spark, base):
    return shown(ind.rsi_wilder(src.instrument_bars(spark, base)), ["rsi_w"])


walk("rsie", "rets", ["a", "z"], {"a": "greatest(ret, 0)", "z": "greatest(-ret, 0)"},
     {"a": "r.a + (greatest(b.ret, 0) - r.a) * 2 / 15.0", "z": "r.z + (greatest(-b.ret, 0) - r.z) * 2 / 15.0"}, [])


@query(with_ctes(f"""SELECT b.code, b.dt, {r('CASE WHEN b.i < 7 THEN 50 ELSE 100 - 100 / (1 + CASE WHEN w.z > 1e-10 THEN w.a / w.z ELSE 1 END) END')} AS rsi_14
  FROM panel b JOIN rsie w ON b.code = w.code AND b.i = w.i""", recursive=True))
def rsi_smoothed(spark, base):
    return shown(ind.rsi_ewm14(ind.daily_return(src.instrument_bars(spark, base))), ["rsi_14"])


cte("dm", f"""SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m
  FROM (SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn FROM wtr)""")
walk("dmw", "dm", ["t", "p", "m"], {"t": "tr", "p": "p::DOUBLE", "m": "m::DOUBLE"},
     {x: f"r.{x} * (1 - 1 / 14.0) + b.{ {'t': 'tr', 'p': 'p', 'm': 'm'}[x]} / 14.0" for x in ("t", "p", "m")}, [])
cte("dxq", """SELECT b.code, b.dt, row_number() OVER (PARTITION BY b.code ORDER BY b.dt) AS i, 100 * w.p / nullif(w.t, 0) AS plus_di,
  100 * w.m / nullif(w.t, 0) AS minus_di, 100 * abs(100 * w.p / nullif(w.t, 0) - 100 * w.m / nullif(w.t, 0)) /
  (100 * w.p / nullif(w.t, 0) + 100 * w.m / nullif(w.t, 0) + 1e-10) AS dx
  FROM dm b JOIN dmw w ON b.code = w.code AND b.i = w.i""")
cte("dxn", "SELECT code, dt, dx, row_number() OVER (PARTITION BY code ORDER BY dt) AS i FROM dxq WHERE dx IS NOT NULL")
walk("adxw", "dxn", ["a"], {"a": "dx"}, {"a": "r.a * (1 - 1 / 14.0) + b.dx / 14.0"}, [])


@query(with_ctes(f"""SELECT b.code, b.dt, {rsel({'plus_di': 'b.plus_di', 'minus_di': 'b.minus_di', 'dx': 'b.dx', 'adx': 'w.a'}, 3)}
  FROM dxq b LEFT JOIN dxn n ON b.code = n.code AND b.dt = n.dt LEFT JOIN adxw w ON n.code = w.code AND n.i = w.i""", recursive=True))
def adx(spark, base):
    return shown(ind.adx(src.week_bars(spark, base)), ["plus_di", "minus_di", "dx", "adx"], 3)


cte("trendq", f"""SELECT *, count(close) {over(20)} AS n, corr(close, i) {over(20)} AS c, regr_slope(close, i) {over(20)} AS b, avg(close) {over(20)} AS m FROM panel""")


@query(with_ctes(f"""SELECT code, dt, {rsel({'trend_r2': 'CASE WHEN n >= 20 THEN coalesce(c * c, 0) * 10 END', 'trend_slope': 'CASE WHEN n >= 20 THEN b / m * 100 END'}, 3)} FROM trendq"""))
def trend_stability(spark, base):
    return shown(ind.trend(src.instrument_bars(spark, base)), ["trend_r2", "trend_slope"], 3)


cte("liq", f"""SELECT *, CASE WHEN amount > 0 THEN abs(ret) / 100 / amount ELSE 0 END AS pa, greatest(ln(high / low), 0) AS hl,
  lag(high) {W} AS h1, lag(low) {W} AS l1 FROM (SELECT *, coalesce(pct_chg, 0) AS ret FROM weekpanel)""")


@query(with_ctes(f"""SELECT code, dt, {rsel({'amihud_illiq_20d': f'avg(pa) {over(20)} * 1e6', 'price_impact': f'avg(pa) {over(20)} * 1e9',
  'log_spread': 'ln(1 + CASE WHEN h1 IS NULL THEN 0 ELSE greatest(0, 2 * (exp(be) - exp(ga)) / greatest(1e-10, 2 + exp(be) - 2 * exp(ga))) * 100 END)',
  'high_low_ratio_20d': f'avg(hl) {over(20)}', 'amihud_5d_mean': f'avg(abs(pct_chg) / 100 / amount * 1e6) {over(5)}'}, 6)}
  FROM (SELECT *, ln(high / low) ** 2 + ln(h1 / l1) ** 2 AS be, ln(greatest(high, h1) / least(low, l1)) ** 2 AS ga FROM liq)"""))
def liquidity(spark, base):
    d = ind.liquidity(ind.daily_return(src.week_panel(spark, base))).withColumn("price_impact", F.col("price_impact") * 1e9)
    d = d.withColumn("log_spread", F.log1p("corwin_schultz_spread"))
    return shown(d, ["amihud_illiq_20d", "price_impact", "log_spread", "high_low_ratio_20d", "amihud_5d_mean"], 6)


K = 0.34 / (1.34 + 21 / 19)


@query(with_ctes(f"""SELECT code, dt, {r(f'CASE WHEN i > 20 THEN sqrt(var_samp(o) {over(19)} + {K!r} * var_samp(oc) {over(20)} + (1 - {K!r}) * avg(rs) {over(20)}) * 100 ELSE 0 END')} AS yang_zhang_vol
  FROM (SELECT *, ln(open / pre_close) AS o, ln(close / open) AS oc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM weekpanel)"""))
def yang_zhang_volatility(spark, base):
    return shown(ind.yang_zhang(src.week_bars(spark, base)), ["yang_zhang_vol"])


@query(with_ctes(f"""SELECT code, dt, {r('CASE WHEN i > 20 THEN list_sum([xs[k] * exp(-0.2 * (20 - k)) FOR k IN range(1, 21)]) / (SELECT sum(exp(-0.2 * k)) FROM range(20) t(k)) ELSE 0 END')} AS exp_wgt_return_20d
  FROM (SELECT *, list(ret) {over(20)} AS xs FROM rets)"""))
def decayed_return(spark, base):
    return shown(ind.decayed_return(ind.daily_return(src.instrument_bars(spark, base))), ["exp_wgt_return_20d"])


@query(with_ctes(f"SELECT code, dt, {rsel({f'fwd_ret_{n}': f'(lead(close, {n}) {W} / close - 1) * 100' for n in (5, 10, 20)})} FROM panel"))
def forward_return(spark, base):
    return shown(ind.forward_return(src.instrument_bars(spark, base)), ["fwd_ret_5", "fwd_ret_10", "fwd_ret_20"])


FWD = "OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"


@query(with_ctes(f"""SELECT code, dt, {r('dd')} AS fwd_dd, CASE WHEN n >= 3 AND dd <= -0.05 THEN 1 ELSE 0 END AS risk_label
  FROM (SELECT *, (min(close) {FWD} - lead(close) {W}) / lead(close) {W} AS dd, count(close) {FWD} AS n FROM l1panel)"""))
def forward_drawdown(spark, base):
    d = ind.forward_drawdown(src.l1_bars(spark, base))
    return d.select("code", "dt", rd("fwd_dd").alias("fwd_dd"), "risk_label")


@query(with_ctes(f"""SELECT code, dt, {r('peak')} AS peak, {r('(close / peak - 1) * 100')} AS drawdown_pct
  FROM (SELECT *, max(close) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM panel)"""))
def running_drawdown(spark, base):
    return shown(ind.drawdown(src.instrument_bars(spark, base)), ["peak", "drawdown_pct"])


@query(with_ctes(f"""SELECT code, dt, {r('CASE WHEN n >= 20 AND p > 0 THEN vol / p ELSE 1 END')} AS turnover_ratio
  FROM (SELECT *, avg(vol) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p,
  count(vol) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM panel)"""))
def turnover_ratio(spark, base):
    return shown(ind.volume_over_earlier(src.instrument_bars(spark, base)), ["turnover_ratio"])

"""Row-level rules, gates, texts and joins between panels."""

from pyspark.sql import functions as F

from ..functions.scalar import div0, rd, safe_div
from ..operators import cross, flows, indicators as ind, joins, market as mkt, predicates as rule, text
from ..operators.snapshots import latest_rows
from ..session import materialised
from ..sources import bars as src
from ..sources import ingest
from ..sources.tables import table
from .ctes import EXACT, W, cte, over, r, rolled, with_ctes
from .registry import query
from .windows import _pos, rsel, shown

cte("feat", f"""SELECT *, round(vol / avg(vol) {over(20)}, 4) AS spike, coalesce(avg(tr) {over(14)} / close * 100, 0) AS atr_pct, {_pos(20)} AS pos20 FROM (
  SELECT code, dt, i, close, high, low, vol, amount, (close / lag(close, 5) {W} - 1) * 100 AS mom5, (close / lag(close, 20) {W} - 1) * 100 AS mom20,
  (close / avg(close) {over(20)} - 1) * 100 AS ma20_dev, vol / avg(vol) {over(20)} AS vol_ratio,
  CASE WHEN pre_close IS NOT NULL THEN greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END AS tr FROM panel)""")


def feats(spark, base, bars=None, kept=()):
    """Features of every bar, with the columns ``kept`` of the bars."""
    d = ind.moving_averages(ind.momenta(src.instrument_bars(spark, base) if bars is None else bars, (5, 20)), (20,))
    d = ind.atr_sma(ind.volume_spike(d))
    return d.select("code", "dt", "close", "high", "low", "vol", "amount", "mom5", "mom20", "ma20_dev", F.col("vol_spike").alias("spike"), "atr_pct",
                    ind.price_position(20).alias("pos20"), ind.nz(div0("vol", ind.mean_n("vol", 20))).alias("vol_ratio"), *kept)


@query(with_ctes(f"SELECT code, dt, {r('CASE WHEN abs(low_mf) > 1e-10 THEN buy / low_mf ELSE 0 END')} AS ratio FROM (SELECT code, dt, buy_elg_amount AS buy, sell_elg_amount AS low_mf FROM moneyflow)"))
def safe_division(spark, base):
    return src.moneyflow(spark, base).select("code", "dt", rd(safe_div("buy_elg_amount", "sell_elg_amount")).alias("ratio"))


@query("""SELECT s_suppkey AS code, CASE WHEN s LIKE '60%' THEN 1.0 WHEN s LIKE '00%' THEN 2.0 WHEN s LIKE '30%' THEN 3.0 WHEN s LIKE '68%' THEN 4.0 WHEN s LIKE '4%' OR s LIKE '8%' THEN 5.0 ELSE 0.0 END::DOUBLE AS board_type,
  s LIKE '30%' OR s LIKE '68%' AS wide FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS s FROM supplier)""")
def board_type(spark, base):
    return table(spark, base, "supplier").select(F.col("s_suppkey").alias("code"), rule.board_type("s_suppkey").alias("board_type"), rule.wide_limit("s_suppkey").alias("wide"))


@query(with_ctes(f"SELECT code, dt, {r('close')} AS close, {r('mom5')} AS mom5 FROM feat WHERE close >= 3 AND vol > 0 AND mom5 IS NOT NULL"))
def tradable_rows(spark, base):
    return shown(rule.tradable(feats(spark, base)), ["close", "mom5"])


@query(with_ctes("SELECT code, name, l2_name FROM members WHERE NOT regexp_matches(l2_name, 'IRAN|UNITED|INDIA')"))
def exclude_keywords(spark, base):
    return rule.without_keywords(src.members(spark, base), "l2_name", ["IRAN", "UNITED", "INDIA"]).select("code", "name", "l2_name")


TIERS = [("panic", ["password", "token ="]), ("excited", ["License", "licence"]), ("negative", ["worthless", "nicht"]),
         ("positive", ["thing", "oning"]), ("negative", ["hehely", "mente"]), ("positive", ["attion", "outre"])]
LABELS = [("password", "secret"), ("@", "mail"), ("License", "licence"), ("http", "link"), ("nicht", "german"), ("le ", "latin")]
MOOD = "CASE " + " ".join(f"WHEN regexp_matches(text, '{'|'.join(w)}') THEN '{k}'" for k, w in TIERS) + " ELSE 'neutral' END"
LABEL = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{k}'" for w, k in LABELS) + " END"
cte("news", f"SELECT doc_id, lang, source, text, {MOOD} AS mood, {LABEL} AS label FROM documents")


@query(with_ctes("SELECT doc_id, mood FROM news"))
def classify_news(spark, base):
    return table(spark, base, "documents").select("doc_id", text.classify_text("text", TIERS).alias("mood"))


@query(with_ctes("SELECT doc_id, label FROM news"))
def classify_announcements(spark, base):
    return table(spark, base, "documents").select("doc_id", text.classify_title("text", LABELS).alias("label"))


cte("newsq", """SELECT source, count(*) AS total_news, count(*) FILTER (mood IN ('negative', 'panic')) AS negative_count, count(*) FILTER (mood = 'panic') AS panic_count,
  count(*) FILTER (mood IN ('positive', 'excited')) AS positive_count, count(*) FILTER (mood = 'excited') AS excited_count FROM news GROUP BY source""")
cte("newsl", """SELECT *, negative_count * 100.0::DOUBLE / total_news AS np, positive_count * 100.0::DOUBLE / total_news AS pp FROM newsq""")
NEWS_LEVEL = """CASE WHEN panic_count > 2 THEN 'panic' WHEN excited_count > 3 THEN 'excited' WHEN np > 30 THEN 'negative' WHEN pp > 30 THEN 'positive'
  WHEN np > 15 THEN 'mild_negative' WHEN pp > 15 THEN 'mild_positive' ELSE 'calm' END"""


def news_rows(spark, base):
    return table(spark, base, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("title"), text.classify_text("text", TIERS).alias("mood"))


@query(with_ctes(f"""SELECT q.source, total_news, negative_count, panic_count, positive_count, excited_count, {r('np')} AS negative_pct, {r('pp')} AS positive_pct, {NEWS_LEVEL} AS level, h.top_negative
  FROM newsl q LEFT JOIN (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY k) AS top_negative FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM news WHERE mood IN ('negative', 'panic')) WHERE k <= 3 GROUP BY source) h ON h.source = q.source"""))
def news_summary(spark, base):
    d = text.news_summary(news_rows(spark, base), ["source"])
    return d.withColumns({"negative_pct": rd("negative_pct"), "positive_pct": rd("positive_pct")})


@query(with_ctes(f"""SELECT n.source, w.warning, n.level, CASE WHEN level = 'panic' AND warning IN ('warning', 'danger', 'caution') THEN 'elevated' WHEN level = 'negative' AND warning IN ('warning', 'danger') THEN 'elevated' ELSE 'normal' END AS overlay,
  CASE WHEN level = 'panic' AND warning IN ('warning', 'danger') THEN 'reduce_strictly' WHEN level = 'panic' AND warning = 'caution' THEN 'tighten_position' WHEN level = 'panic' THEN 'watch_panic'
  WHEN level = 'negative' AND warning IN ('warning', 'danger') THEN 'reduce' WHEN level = 'negative' THEN 'watch' WHEN level = 'excited' AND warning IN ('warning', 'danger') THEN 'mood_gap' WHEN level = 'excited' THEN 'overheated' END AS suggestion
  FROM (SELECT source, {NEWS_LEVEL} AS level FROM newsl) n, (SELECT unnest(['normal', 'caution', 'warning', 'danger']) AS warning) w"""))
def confidence_overlay(spark, base):
    d = text.news_summary(news_rows(spark, base), ["source"]).select("source", "level", F.explode(F.array(*[F.lit(x) for x in ("normal", "caution", "warning", "danger")])).alias("warning"))
    return d.select("source", "warning", "level", *[e.alias(n) for n, e in text.confidence_overlay(F.col("warning"), F.col("level")).items()])


EVENT_DAY = "DATE '1995-01-02' + CAST(doc_id % 2000 AS INTEGER)"
cte("events_q", f"""SELECT doc_id, doc_id % (SELECT count(*) FROM supplier) AS code, {EVENT_DAY} AS event_date, label FROM news WHERE label IS NOT NULL""")


@query(with_ctes("""SELECT code, count(*) AS n_events, max(event_date) AS last_event, string_agg(CASE WHEN k <= 3 THEN label || CASE WHEN ago <= 7 THEN ' recent' ELSE '' END END, ' | ' ORDER BY k) AS warnings FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY event_date DESC, doc_id DESC) AS k, (SELECT max(event_date) FROM events_q) - event_date AS ago FROM events_q
  WHERE event_date >= (SELECT max(event_date) FROM events_q) - 90) GROUP BY code"""))
def announcement_warnings(spark, base):
    d = table(spark, base, "documents").select("doc_id", text.classify_title("text", LABELS).alias("event_type"))
    n = table(spark, base, "supplier").agg(F.count(F.lit(1))).scalar()
    ev = d.where("event_type is not null").select(
        (F.col("doc_id") % n).alias("code"), F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2000).cast("int")).alias("event_date"),
        "event_type", F.col("doc_id").alias("event_id"))
    return text.event_warnings(ev, ev.agg(F.max("event_date")).scalar())


@query(with_ctes("""SELECT code, dt, array_to_string(list_filter([CASE WHEN ma20_dev > 50 THEN 'severe_overbought' WHEN ma20_dev > 30 THEN 'overbought' END, CASE WHEN mom5 > 50 THEN 'short_term_spike' END,
  CASE WHEN vol_ratio < 0.3 THEN 'severe_shrink' END, CASE WHEN atr_pct > 10 THEN 'extreme_range' END], lambda x: x IS NOT NULL), ',') AS warnings FROM feat"""))
def overbought_warnings(spark, base):
    return feats(spark, base).select("code", "dt", F.array_join(rule.overbought_warnings("ma20_dev", "mom5", "vol_ratio", "atr_pct"), ",").alias("warnings"))


@query(with_ctes(f"SELECT code, dt, {r('CASE WHEN ar_turn > 5000 THEN 0 WHEN ar_turn > 0 THEN 365 / ar_turn END')} AS dso FROM valuation"))
def days_sales_outstanding(spark, base):
    return src.valuation(spark, base).select("code", "dt", rd(rule.dso("ar_turn")).alias("dso"))


@query(with_ctes("SELECT code, dt, CASE WHEN p_momentum >= 0.55 THEN 'pass' ELSE 'veto' END AS gate FROM scores"))
def winrate_gate(spark, base):
    return src.engine_scores(spark, base).select("code", "dt", rule.winrate_gate("p_momentum").alias("gate"))


@query(with_ctes(f"""SELECT code, dt, {r('bonus')} AS vol_shock_bonus, {r('boost')} AS vol_shock_conf_boost, {r('(50 + bonus) * boost')} AS score_out FROM (
  SELECT code, dt, CASE WHEN spike > 1.5 THEN round(5 + 3 * least(greatest((spike - 1.5) / 1.5, 0), 1) + 1e-6, 2) ELSE 0 END AS bonus, CASE WHEN spike < 0.7 THEN 1.1 ELSE 1.0 END AS boost FROM feat)"""))
def volume_shock_bonus(spark, base):
    d = feats(spark, base).withColumn("score", F.lit(50.0))
    return shown(d.select("code", "dt", *[e.alias(n) for n, e in rule.volume_bonus("score", "spike").items()]), ["vol_shock_bonus", "vol_shock_conf_boost", "score_out"])


cte("scorefeat", "SELECT s.*, f.spike, f.pos20, f.ma20_dev, f.mom5, f.atr_pct FROM scores s JOIN feat f USING (code, dt)")


def score_feats(spark, base):
    return src.with_engine_scores(feats(spark, base)).drop("mom20", "vol_ratio", "high", "low")


@query(with_ctes(f"""SELECT code, dt, {rsel({
  'p_momentum': "least(greatest(p_momentum + CASE WHEN spike > 1.5 AND pos20 >= 0.7 THEN up ELSE 0 END, 0), 1)",
  'p_breakout': "least(greatest(p_breakout + CASE WHEN spike > 1.5 THEN up ELSE 0 END, 0), 1)",
  'p_reversion': "least(greatest(p_reversion + CASE WHEN spike < 0.7 AND ma20_dev < 0 THEN dn ELSE 0 END, 0), 1)",
  'vol_reversion_confirmed': "CASE WHEN spike < 0.7 AND ma20_dev < 0 THEN 1 ELSE 0 END"})} FROM (
  SELECT *, least(greatest((spike - 1.5) / spike, 0), 1) * 0.03 + 0.05 AS up, least(greatest((0.7 - spike) / 0.7, 0), 1) * 0.03 + 0.05 AS dn FROM scorefeat)"""))
def engine_volume_adjust(spark, base):
    d = score_feats(spark, base)
    cols = rule.engine_volume_adjust("spike", "pos20", "ma20_dev")
    return shown(d.select("code", "dt", *[e.alias(n) for n, e in cols.items()]), ["p_momentum", "p_breakout", "p_reversion", "vol_reversion_confirmed"])


@query(with_ctes(f"""SELECT code, dt, kind AS vol_boost, {r(r('p_momentum + bonus') + ' * m')} AS score_out FROM (SELECT code, dt, p_momentum,
  CASE WHEN spike > 1.5 THEN 'breakout' WHEN spike < 0.7 THEN 'shrink' ELSE '' END AS kind, CASE WHEN spike < 0.7 THEN 1.1 ELSE 1 END AS m,
  CASE WHEN spike > 1.5 THEN least(greatest((spike - 1.5) / spike, 0), 1) * 0.03 + 0.05 ELSE 0 END AS bonus FROM scorefeat)"""))
def composite_volume_adjust(spark, base):
    cols = rule.volume_adjust("p_momentum", "spike")
    return score_feats(spark, base).select("code", "dt", cols["vol_boost"].alias("vol_boost"), cols["score_out"].alias("score_out"))


@query(with_ctes(f"""SELECT code, dt, {r('least(greatest(m / 0.55, 0.3), 1.2)')} AS soft_multiplier, {r('m * least(greatest(m / 0.55, 0.3), 1.2)')} AS composite_score, {r('p_momentum * 0.6 + p_reversion * 0.2 + p_breakout * 0.2')} AS bull_score
  FROM (SELECT *, (p_momentum + p_reversion + p_breakout) / 3 AS m FROM scores)"""))
def soft_weight(spark, base):
    probs = ["p_momentum", "p_reversion", "p_breakout"]
    mean = sum((F.col(p) for p in probs[1:]), F.col(probs[0])) / 3
    mult = ind.clip(mean / 0.55, 0.3, 1.2)
    bull = rule.combined({"p_momentum": 0.6, "p_reversion": 0.2, "p_breakout": 0.2})
    return src.engine_scores(spark, base).select("code", "dt", rd(mult).alias("soft_multiplier"), rd(mean * mult).alias("composite_score"), rd(bull).alias("bull_score"))


@query(with_ctes(f"""SELECT code, dt, {r('mom20')} AS mom20, {r('ma20_dev')} AS ma20_dev, {r('atr_pct')} AS atr_pct FROM feat"""))
def mask_features(spark, base):
    from ..plans.features import mask

    return shown(mask(feats(spark, base), ["mom20", "ma20_dev", "atr_pct", "not_there"]), ["mom20", "ma20_dev", "atr_pct"])


# ---- joins -------------------------------------------------------------------------------


@query(with_ctes(f"""SELECT p.code, p.dt, {r('p.close')} AS close, coalesce(m.l2_name, 'UNKNOWN') AS l2_name FROM panel p LEFT JOIN (SELECT code, l2_name FROM members WHERE l1_name <> 'EUROPE') m ON m.code = p.code"""))
def instrument_dimension(spark, base):
    dim = src.members(spark, base).where("l1_name <> 'EUROPE'")
    return joins.with_dimension(src.instrument_bars(spark, base), dim, ["l2_name"]).select("code", "dt", rd("close").alias("close"), "l2_name")


@query(with_ctes(f"""SELECT p.code, p.dt, h.dt AS asof_dt, {r('h.ind_ret')} AS ind_ret FROM (SELECT b.code, b.dt, m.l2 FROM panel b JOIN members m USING (code)) p
  ASOF LEFT JOIN (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS ind_ret FROM l2panel QUALIFY lag(close, 20) {W} IS NOT NULL AND dt < DATE '2001-01-01') h ON h.code = p.l2 AND p.dt >= h.dt"""))
def industry_return_asof(spark, base):
    hist = src.l2_bars(spark, base).withColumn("ind_ret", ind.momentum(20)).where("dt < date'2001-01-01'")
    parents = src.members(spark, base).select("code", F.col("l2").alias("parent"))
    d = joins.asof_returns(src.instrument_bars(spark, base), hist, parents)
    return d.select("code", "dt", "asof_dt", rd("ind_ret").alias("ind_ret"))


@query(with_ctes(f"""SELECT code, max(dt) AS dt, {r('arg_max(pe_ttm, dt)')} AS pe_ttm, {r('arg_max(pb, dt)')} AS pb FROM valuation WHERE dt <= DATE '2000-06-15' AND pe_ttm IS NOT NULL AND pb IS NOT NULL GROUP BY code"""))
def valuation_asof(spark, base):
    d = joins.latest_asof(src.valuation(spark, base), ["pe_ttm", "pb"], F.lit("2000-06-15").cast("date"))
    return d.select("code", "dt", rd("pe_ttm").alias("pe_ttm"), rd("pb").alias("pb"))


@query(with_ctes(f"""SELECT p.code, p.dt, {rsel({'rzye': 'g.rzye', 'net_mf_amount': 'f.net_mf_amount', 'pe_ttm': 'v.pe_ttm'}, 3)} FROM panel p LEFT JOIN margin g ON g.code = p.code AND g.dt = p.dt
  LEFT JOIN moneyflow f ON f.code = p.code AND f.dt = p.dt LEFT JOIN valuation v ON v.code = p.code AND v.dt = p.dt"""))
def external_panels(spark, base):
    d = joins.external_panels(src.instrument_bars(spark, base).select("code", "dt"), [
        (src.margin(spark, base), ["rzye"]), (src.moneyflow(spark, base), ["net_mf_amount"]), (src.valuation(spark, base), ["pe_ttm"])])
    return shown(d, ["rzye", "net_mf_amount", "pe_ttm"], 3)


@query(with_ctes("SELECT code, dt, p_momentum, p_reversion, p_breakout FROM scores WHERE p_momentum >= 0.2 AND p_reversion >= 0.1 AND p_breakout >= 0.3"))
def engine_probabilities(spark, base):
    s = materialised(src.engine_scores(spark, base).select("dt", "code", *[f"p_{e}" for e in src.ENGINE_SEEDS]))  # bars are built once, not in the tasks that join
    panels = [s.where(f"p_{e} >= {x}").select("dt", "code", f"p_{e}") for e, x in (("momentum", 0.2), ("reversion", 0.1), ("breakout", 0.3))]
    return joins.inner_all(panels)


cte("decayq", """SELECT a.code, a.p_momentum AS p_init, coalesce(b.p_momentum, 0) AS p_today FROM (SELECT code, arg_min(p_momentum, dt) AS p_momentum FROM scores WHERE dt >= DATE '2000-01-03' GROUP BY code) a
  LEFT JOIN (SELECT code, arg_min(p_momentum, dt) AS p_momentum FROM scores WHERE dt >= DATE '2001-09-03' GROUP BY code) b USING (code)""")


@query(with_ctes("""SELECT code, p_init, p_today, round(p_init * 0.75 + 1e-8, 4) AS threshold, CASE WHEN p_init > 0 THEN round(p_today / p_init + 1e-8, 4) ELSE 1.0 END::DOUBLE AS decay, p_today < round(p_init * 0.75 + 1e-8, 4) AS alpha_decay_cut FROM decayq"""))
def alpha_decay(spark, base):
    s = src.engine_scores(spark, base)
    first = lambda since, name: s.where(f"dt >= date'{since}'").groupBy("code").agg(F.min_by("p_momentum", "dt").alias(name))
    d = first("2000-01-03", "p_init").join(first("2001-09-03", "p_today"), "code", "left").withColumn("p_today", F.coalesce("p_today", F.lit(0.0)))
    return d.select("code", "p_init", "p_today", *[e.alias(n) for n, e in rule.alpha_decay("p_init", "p_today").items()])


cte("gaprisk", f"""SELECT code, count(*) AS n, count(*) FILTER (pct_chg >= 5) AS big, count(*) FILTER (pct_chg >= 5 AND coalesce(lead_gap, 0) * 100 <= -1) AS hit, min(dt) AS window_start, max(dt) AS window_end FROM (
  SELECT *, lead(open / pre_close - 1) OVER (PARTITION BY code ORDER BY dt) AS lead_gap, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k FROM panel) WHERE k <= 60 GROUP BY code""")
cte("gapscore", "SELECT code, CASE WHEN n >= 20 AND big > 0 THEN round(hit / big::DOUBLE + 1e-8, 4) ELSE 0 END::DOUBLE AS score, CASE WHEN n >= 20 THEN big ELSE 0 END AS big_up_days, CASE WHEN n >= 20 THEN hit ELSE 0 END AS gap_down_after, window_start, window_end, n < 20 AS insufficient FROM gaprisk")


@query(with_ctes("SELECT * FROM gapscore"))
def overnight_gap_risk(spark, base):
    from ..operators.routing import gap_risk

    return gap_risk(src.instrument_panel(spark, base))


cte("lastscore", "SELECT code, arg_max(p_momentum, dt) * 100 AS score FROM scores GROUP BY code")


@query(with_ctes(f"""SELECT s.code, coalesce(g.score, 0) AS t1_lock_risk, coalesce(g.score, 0) > 0.4 AS t1_high_risk, {r('s.score - CASE WHEN coalesce(g.score, 0) > 0.4 THEN 15 ELSE 0 END')} AS score FROM lastscore s LEFT JOIN gapscore g ON g.code = s.code"""))
def gap_penalty(spark, base):
    from ..operators.routing import gap_risk, with_gap_penalty

    s = latest_rows(src.engine_scores(spark, base)).select("code", (F.col("p_momentum") * 100).alias("score"))
    d = with_gap_penalty(s, gap_risk(src.instrument_panel(spark, base)), "score")
    return d.select("code", "t1_lock_risk", "t1_high_risk", rd("score").alias("score"))


cte("folds", """SELECT CAST((date_idx - 1) // 25 AS INTEGER) AS fold, min(dt) AS val_start, max(dt) AS val_end, count(*) AS n_dates FROM calendar GROUP BY 1""")
cte("trades", f"""SELECT dt, code, p_momentum AS win_prob, close AS entry_close, t1_ret, d5_ret, fwd_ret, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY p_momentum DESC, code) AS rk FROM scores) WHERE rk <= 5""")


def folds(spark, base):
    cal = ingest.trading_calendar(src.trade_ticks(spark, base))
    return cal.groupBy(F.floor((F.col("date_idx") - 1) / 25).cast("int").alias("fold")).agg(F.min("dt").alias("val_start"), F.max("dt").alias("val_end"), F.count(F.lit(1)).alias("n_dates"))


def trades(spark, base):
    d = cross.top_n(src.engine_scores(spark, base), ["dt"], "p_momentum", 5)
    return d.select("dt", "code", F.col("p_momentum").alias("win_prob"), F.col("close").alias("entry_close"), "t1_ret", "d5_ret", "fwd_ret", "rk")


@query(with_ctes(f"SELECT f.fold, t.dt, t.code, {r('t.win_prob')} AS win_prob, {r('t.t1_ret')} AS t1_ret FROM trades t JOIN folds f ON t.dt BETWEEN f.val_start AND f.val_end"))
def trades_in_folds(spark, base):
    d = joins.trades_in_folds(trades(spark, base), folds(spark, base).select("fold", "val_start", "val_end"))
    return d.select("fold", "dt", "code", rd("win_prob").alias("win_prob"), rd("t1_ret").alias("t1_ret"))


cte("evd", """SELECT DISTINCT dt FROM l2breadth WHERE down_pct >= 70""")


@query(with_ctes("SELECT e.dt AS event_dt, p.dt, CAST(c.date_idx - p.date_idx AS INTEGER) AS \"offset\" FROM evd e JOIN calendar c ON c.dt = e.dt JOIN calendar p ON p.date_idx BETWEEN c.date_idx - 3 AND c.date_idx - 1"))
def days_before_events(spark, base):
    ev = mkt.breadth(src.with_change(src.l2_bars(spark, base))).where("down_pct >= 70").select("dt")
    return joins.days_before_events(ev, ingest.trading_calendar(src.trade_ticks(spark, base)), 3)


@query(with_ctes(f"""SELECT p.code, p.dt AS entry_dt, {r('p.close')} AS entry_close, CAST(p.k AS INTEGER) AS k, b.dt, {r('b.close')} AS close FROM (SELECT t.code, t.dt, q.close, q.i, unnest(range(1, 6)) AS k FROM trades t JOIN panel q ON q.code = t.code AND q.dt = t.dt) p JOIN panel b ON b.code = p.code AND b.i = p.i + p.k""").replace("panel AS (", "panel AS MATERIALIZED (").replace("trades AS (", "trades AS MATERIALIZED ("))
def forward_bars(spark, base):
    d = joins.forward_bars(trades(spark, base), src.instrument_bars(spark, base), 5)
    return d.select("code", "entry_dt", rd("entry_close").alias("entry_close"), "k", "dt", rd("close").alias("close"))


@query(with_ctes("""SELECT code, 'kept' AS side FROM (SELECT DISTINCT code FROM trades WHERE dt >= DATE '2001-06-01' INTERSECT SELECT DISTINCT code FROM trades WHERE dt BETWEEN DATE '2001-01-01' AND DATE '2001-05-31')
  UNION ALL SELECT code, 'new' FROM (SELECT DISTINCT code FROM trades WHERE dt >= DATE '2001-06-01' EXCEPT SELECT DISTINCT code FROM trades WHERE dt BETWEEN DATE '2001-01-01' AND DATE '2001-05-31')"""))
def semi_and_anti(spark, base):
    t = trades(spark, base)
    now = t.where("dt >= date'2001-06-01'").select("code").distinct()
    held = t.where("dt between date'2001-01-01' and date'2001-05-31'").select("code").distinct()
    return joins.common_codes(now, held).withColumn("side", F.lit("kept")).unionByName(joins.without_codes(now, held).withColumn("side", F.lit("new")))


cte("hist", "SELECT mom20 AS score, fwd AS outcome, hist_id FROM (SELECT mom20, (lead(close, 5) OVER (PARTITION BY code ORDER BY dt) / close - 1) * 100 AS fwd, code * 100000 + datediff('day', DATE '1995-01-01', dt) AS hist_id FROM feat) WHERE mom20 IS NOT NULL AND fwd IS NOT NULL")
cte("cand", "SELECT code AS cand_id, arg_max(mom20, dt) AS score FROM feat GROUP BY code")


@query(with_ctes("""SELECT cand_id, count(*) AS n_near, round(avg(outcome) + 1e-8, 4) + 0.0 AS mean_outcome,
  round(avg(CASE WHEN outcome > 0 THEN 100.0::DOUBLE ELSE 0 END) + 1e-8, 4) AS win_rate, round(max(d) + 1e-8, 4) AS max_distance FROM (
  SELECT c.cand_id, h.outcome, abs(h.score - c.score) AS d, row_number() OVER (PARTITION BY c.cand_id ORDER BY abs(h.score - c.score), abs(h.pos - c.place - 0.5), h.pos) AS k
  FROM (SELECT *, (SELECT count(*) FROM hist WHERE hist.score < cand.score) AS place FROM cand) c JOIN (SELECT score, outcome, row_number() OVER (ORDER BY score, hist_id) AS pos FROM hist) h ON true) WHERE k <= 80 GROUP BY cand_id HAVING count(*) >= 10"""))
def nearest_by_score(spark, base):
    f = materialised(feats(spark, base).select("code", "dt", "mom20", ((F.lead("close", 5).over(ind.series()) / F.col("close") - 1) * 100).alias("outcome")))
    hid = F.col("code") * 100000 + F.datediff("dt", F.lit("1995-01-01").cast("date"))
    hist = f.select(F.col("mom20").alias("score"), "outcome", hid.alias("hist_id")).where("score is not null and outcome is not null")
    cand = latest_rows(f.select("code", "dt", "mom20")).select(F.col("code").alias("cand_id"), F.col("mom20").alias("score"))
    d = joins.nearest_by_score(cand, hist)
    return d.select("cand_id", "n_near", rd("mean_outcome").alias("mean_outcome"), rd("win_rate").alias("win_rate"), rd("max_distance").alias("max_distance"))


# ---- flow and margin derivatives ---------------------------------------------------------


@query(with_ctes(f"""SELECT code, dt, {rsel({'margin_balance_change': 'coalesce(rzye / nullif(lag(rzye) ' + W + ', 0) - 1, 0)', 'margin_buy_intensity': 'rzmre / nullif(rzye + 1e-10, 0) * 100', 'margin_net_buy': 'coalesce(rzye - lag(rzye) ' + W + ', 0)'}, 2)} FROM margin""", EXACT))
def margin_features(spark, base):
    return shown(flows.margin_features(src.margin(spark, base)), ["margin_balance_change", "margin_buy_intensity", "margin_net_buy"], 2)


cte("flowq", """SELECT *, net_mf_amount / (buy_elg_amount + sell_elg_amount + 1e-10) AS ratio FROM moneyflow""")


@query(with_ctes(f"""SELECT code, dt, {r('ratio')} AS net_mf_ratio, {r('(rank() OVER (PARTITION BY dt ORDER BY ratio) + (count(*) OVER (PARTITION BY dt, ratio) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) * 100')} AS mf_intensity_rank FROM flowq""", EXACT))
def flow_features(spark, base):
    return shown(flows.flow_features(src.moneyflow(spark, base)), ["net_mf_ratio", "mf_intensity_rank"])


@query(with_ctes(f"""SELECT s.code, {r('coalesce(f.net, 0)', 2)} AS net_mf_amount, CASE WHEN f.net > 0 THEN 'inflow' WHEN f.net < 0 THEN 'outflow' ELSE 'neutral' END AS moneyflow,
  {r('CASE WHEN f.net > 0 THEN s.score + 0.5 WHEN f.net < 0 THEN greatest(s.score - 0.3, 0) ELSE s.score END')} AS score FROM lastscore s
  LEFT JOIN (SELECT code, sum(net_mf_amount) AS net FROM moneyflow WHERE dt >= (SELECT min(dt) FROM (SELECT DISTINCT dt FROM moneyflow ORDER BY dt DESC LIMIT 20)) GROUP BY code) f ON f.code = s.code"""))
def moneyflow_adjustment(spark, base):
    s = latest_rows(src.engine_scores(spark, base)).select("code", (F.col("p_momentum") * 100).alias("score"))
    d = flows.adjust_by_flow(s, ingest.read_recent(src.moneyflow(spark, base), 20))
    return d.select("code", rd("net_mf_amount", 2).alias("net_mf_amount"), "moneyflow", rd("score").alias("score"))

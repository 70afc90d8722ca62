"""Scans, ingestion and calendar."""

from pyspark.sql import functions as F

from ..functions.scalar import one_if, rd
from ..sources import bars as src
from ..sources import ingest
from ..sources.tables import table
from .ctes import W, cte, r, with_ctes
from .registry import query


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close, vol FROM panel
  WHERE dt >= DATE '1996-01-01' AND code IN (SELECT code FROM panel WHERE dt >= DATE '1996-01-01' GROUP BY code HAVING count(*) >= 20)"""))
def read_bars(spark, base):
    d = ingest.read_bars(src.instrument_bars(spark, base), since="1996-01-01", min_rows=20)
    return d.select("code", "dt", rd("close").alias("close"), "vol")


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM panel WHERE code IN (
  SELECT code FROM panel GROUP BY code HAVING count(*) >= 120 ORDER BY count(*) DESC, code LIMIT 50)"""))
def read_bars_longest(spark, base):
    return ingest.read_bars_top(src.instrument_bars(spark, base), 50).select("code", "dt", rd("close").alias("close"))


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM panel WHERE dt >= (
  SELECT min(dt) FROM (SELECT DISTINCT dt FROM panel ORDER BY dt DESC LIMIT 80))"""))
def read_recent_dates(spark, base):
    return ingest.read_recent(src.instrument_bars(spark, base), 80).select("code", "dt", rd("close").alias("close"))


@query("""SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicate_keys, sum(no_close)::BIGINT AS missing_close,
  sum(no_vol)::BIGINT AS missing_vol, sum(bad)::BIGINT AS negative_vol FROM (
  SELECT count(*) AS n, count(*) FILTER (l_extendedprice IS NULL) AS no_close, count(*) FILTER (l_quantity IS NULL) AS no_vol,
    count(*) FILTER (l_quantity < 0) AS bad FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))""")
def bar_guard(spark, base):
    raw = table(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("dt"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("vol")
    )
    return ingest.bar_violations(raw)


# Stored history = bars shipped before 2000; the incoming batch overlaps it by a year.
@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM panel WHERE dt >= DATE '2000-01-01'"""))
def append_new_bars(spark, base):
    bars = src.instrument_bars(spark, base)
    stored, batch = bars.where("dt < date'2000-01-01'"), bars.where("dt >= date'1999-01-01'")
    return ingest.append_new(stored, batch).select("code", "dt", rd("close").alias("close"))


@query(with_ctes(f"""SELECT l.code, l.dt, {r('l.close')} AS close FROM l2panel l LEFT JOIN (
  SELECT code, max(dt) AS mark FROM l2panel WHERE dt < make_date(1996 + CAST(code % 5 AS INTEGER), 1, 1) GROUP BY code) m ON l.code = m.code
  WHERE l.dt > coalesce(m.mark, DATE '1900-01-01')"""))
def append_after_watermark(spark, base):
    bars = src.l2_bars(spark, base)
    stored = bars.where(F.col("dt") < F.make_date((F.col("code") % 5 + 1996).cast("int"), F.lit(1), F.lit(1)))
    return ingest.append_after_watermark(stored, bars).select("code", "dt", rd("close").alias("close"))


@query(with_ctes("""SELECT code, max(dt) AS last_dt, count(*) AS n_rows, max(dt) < (SELECT max(dt) - 10 FROM panel) AS is_stale FROM panel GROUP BY code"""))
def stale_instruments(spark, base):
    bars = src.instrument_bars(spark, base)
    return ingest.stale_instruments(bars, F.date_sub(bars.agg(F.max("dt")).scalar(), 10))


@query("""SELECT s_suppkey AS code, s_name AS name, coalesce(m.industry, f.industry, 'UNCLASSIFIED') AS industry,
  CASE WHEN m.industry IS NULL THEN 0 ELSE 1 END AS is_member,
  CASE WHEN m.industry IS NOT NULL THEN 'member' WHEN f.industry IS NOT NULL THEN 'fallback' ELSE 'none' END AS source
  FROM supplier LEFT JOIN (SELECT s_suppkey AS code, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0) m ON m.code = s_suppkey
  LEFT JOIN (SELECT n_nationkey, r_name AS industry FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) f ON f.n_nationkey = s_nationkey
  WHERE NOT regexp_matches(s_name, '7$')""")
def build_universe(spark, base):
    s, n, g = (table(spark, base, t) for t in ("supplier", "nation", "region"))
    listing = s.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"))
    member = s.where("s_acctbal > 0").join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"))
    fallback = n.where("n_nationkey % 2 = 0").join(g, n.n_regionkey == g.r_regionkey).select(F.col("n_nationkey").alias("nk"), F.col("r_name").alias("industry"))
    return ingest.build_universe(listing, member, fallback, "7$", "nk")


@query(with_ctes("SELECT l2_name AS industry, code, count(*) OVER (PARTITION BY l2_name) AS n_members FROM members"))
def group_members(spark, base):
    return ingest.group_members(src.members(spark, base).withColumnRenamed("l2_name", "industry"))


@query(with_ctes(f"""SELECT l.code, l.dt, {r('l.close')} AS close, p.parent, p.parent_name FROM l2panel l LEFT JOIN (
  SELECT l2, arg_max(l1, code) AS parent, arg_max(l1_name, code) AS parent_name FROM members GROUP BY l2) p ON p.l2 = l.code"""))
def enrich_parent(spark, base):
    m = src.members(spark, base).select("code", F.col("l2").alias("child"), F.col("l1").alias("parent"), F.col("l1_name").alias("parent_name"))
    kids = src.l2_bars(spark, base).select("code", "dt", rd("close").alias("close"))
    return ingest.enrich_parent(kids, m)


@query(f"""SELECT regexp_replace(code, '\\..*$', '') AS code, strptime(replace(day, '-', ''), '%Y%m%d')::DATE AS dt, {r('close')} AS close FROM (
  SELECT printf('%06d.XS', CAST(l_suppkey AS BIGINT)) AS code, strftime(l_shipdate, '%Y-%m-%d') AS day, l_extendedprice / l_quantity AS close FROM lineitem)""")
def normalise_vendor_rows(spark, base):
    raw = table(spark, base, "lineitem").select(
        F.format_string("%06d.XS", "l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("string").alias("price"),
    )
    d = ingest.normalise_bars(raw, {"symbol": "code", "day": "dt", "price": "close"}, "code", "dt", ["close"])
    return d.select("code", "dt", rd("close").alias("close"))


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM panel WHERE dt >= DATE '1995-01-01' + CAST((code * 37) % 900 AS INTEGER)"""))
def listed_only(spark, base):
    listing = table(spark, base, "supplier").select(
        F.col("s_suppkey").alias("code"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 900).cast("int")).alias("list_date")
    )
    return ingest.listed_only(src.instrument_bars(spark, base), listing).select("code", "dt", rd("close").alias("close"))


@query(with_ctes(f"""SELECT code, dt, {r('rzye', 2)} AS rzye, {r('rzmre', 2)} AS rzmre FROM margin WHERE NOT regexp_matches(CAST(code AS VARCHAR), '^(51|52|56|58|92)')"""))
def margin_shares_only(spark, base):
    return ingest.shares_only(src.margin(spark, base)).select("code", "dt", rd("rzye", 2).alias("rzye"), rd("rzmre", 2).alias("rzmre"))


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM panel WHERE dt <> (SELECT max(dt) FROM panel)"""))
def remove_date_slice(spark, base):
    bars = src.instrument_bars(spark, base)
    return ingest.without_date(bars, bars.agg(F.max("dt")).scalar()).select("code", "dt", rd("close").alias("close"))


@query(with_ctes(f"""SELECT code, dt, {r('mom20')} AS mom20 FROM (SELECT code, dt, (close / lag(close, 20) {W} - 1) * 100 AS mom20 FROM panel)
  WHERE code IN (SELECT code FROM members WHERE l1_name = 'ASIA') AND dt >= (SELECT min(dt) FROM (
    SELECT DISTINCT dt FROM panel WHERE code IN (SELECT code FROM members WHERE l1_name = 'ASIA') ORDER BY dt DESC LIMIT 60))"""))
def load_feature_slice(spark, base):
    from ..operators.indicators import momenta

    codes = src.members(spark, base).where("l1_name = 'ASIA'").select("code")
    d = ingest.feature_slice(momenta(src.instrument_bars(spark, base), (20,)), codes, ["mom20"], 60)
    return d.select("code", "dt", rd("mom20").alias("mom20"))


@query(with_ctes(f"""SELECT code, dt, {r('close')} AS close FROM l2panel WHERE dt >= (SELECT max(dt) - 60 FROM l2panel)"""))
def history_retention(spark, base):
    return ingest.retain(src.l2_bars(spark, base), 60).select("code", "dt", rd("close").alias("close"))


@query("""WITH s AS (SELECT 'events' AS source, CAST(max(ts) AS DATE) AS last_dt FROM events
  UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE) FROM lineitem UNION ALL SELECT 'orders', CAST(max(o_orderdate) AS DATE) FROM orders),
  n AS (SELECT max(last_dt) AS now FROM s), lagged AS (SELECT source, last_dt, (SELECT count(*) FROM range(last_dt + 1, now + 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)::INTEGER AS lag_days FROM s, n)
  SELECT *, lag_days > 1 AS is_stale FROM lagged""")
def freshness(spark, base):
    parts = [
        table(spark, base, t).agg(F.max(c).cast("date").alias("last_dt")).withColumn("source", F.lit(t))
        for t, c in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"))
    ]
    newest = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ingest.freshness(newest, newest.agg(F.max("last_dt")).scalar(), 1)


@query(with_ctes("SELECT dt, CAST(date_idx AS INTEGER) AS date_idx FROM calendar"))
def trading_calendar(spark, base):
    return ingest.trading_calendar(src.trade_ticks(spark, base))


@query(with_ctes("""SELECT o.dt, c.dt AS trade_dt, CAST(c.date_idx AS INTEGER) AS date_idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders) o
  ASOF LEFT JOIN calendar c ON o.dt >= c.dt"""))
def nearest_trading_day(spark, base):
    days = table(spark, base, "orders").select(F.to_date("o_orderdate").alias("dt")).distinct()
    return ingest.nearest_trading_day(days, ingest.trading_calendar(src.trade_ticks(spark, base))).select("dt", "trade_dt", "date_idx")


@query(f"""SELECT s_suppkey AS code, {r('s_acctbal', 2)} AS pe_ttm, NULL::DOUBLE AS total_mv, NULL::VARCHAR AS note FROM supplier""")
def schema_migrate(spark, base):
    old = table(spark, base, "supplier").select(F.col("s_suppkey").alias("code"), rd("s_acctbal", 2).alias("pe_ttm"))
    return ingest.migrate(old, {"pe_ttm": "double", "total_mv": "double", "note": "string"})

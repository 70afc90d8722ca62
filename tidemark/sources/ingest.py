"""Scans and incremental loading of panel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_join
from ..functions.scalar import one_if, tiers

INTRADAY_COLUMNS = {"time", "minute", "datetime", "freq", "interval"}
# Fund and other non-share code prefixes left out of the margin panel.
NON_SHARE_PREFIXES = ("51", "52", "56", "58", "92")


def as_day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def read_bars(
    bars: DataFrame, codes: Sequence | None = None, since: str | None = None, upto: str | None = None, min_rows: int = 20
) -> DataFrame:
    """Range and membership scan; instruments with fewer than ``min_rows`` rows are dropped."""
    if codes is not None:
        bars = bars.where(F.col("code").isin(list(codes)))
    if since is not None:
        bars = bars.where(F.col("dt") >= as_day(since))
    if upto is not None:
        bars = bars.where(F.col("dt") <= as_day(upto))
    enough = bars.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return bars.join(enough, "code", "left_semi")


def read_bars_top(bars: DataFrame, n: int, min_days: int = 120, universe: DataFrame | None = None) -> DataFrame:
    """Bars of the n instruments with the longest history (ties by code)."""
    if universe is not None:
        bars = bars.join(universe, "code", "left_semi")
    counts = bars.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_days)
    return bars.join(counts.orderBy(F.desc("_n"), "code").limit(n), "code", "left_semi")


def read_recent(bars: DataFrame, n_dates: int, asof: str | Column | None = None) -> DataFrame:
    """Bars of the last ``n_dates`` distinct dates; the cutoff is a scalar subquery."""
    if asof is not None:
        bars = bars.where(F.col("dt") <= as_day(asof))
    dates = bars.select("dt").distinct().orderBy(F.desc("dt")).limit(n_dates)
    return bars.where(F.col("dt") >= dates.agg(F.min("dt")).scalar())


def bar_violations(df: DataFrame) -> DataFrame:
    """Counts of what a daily bar table must not contain; raises on intraday columns."""
    banned = INTRADAY_COLUMNS & {x.lower() for x in df.columns}
    if banned:
        raise ValueError(f"daily bars carry intraday columns: {sorted(banned)}")
    per_key = df.groupBy("code", "dt").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(one_if(F.col("close").isNull())).alias("no_close"),
        F.sum(one_if(F.col("vol").isNull())).alias("no_vol"),
        F.sum(one_if(F.col("vol") < 0)).alias("bad_vol"),
    )
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.sum(one_if(F.col("n") > 1)).alias("duplicate_keys"),
        F.sum("no_close").alias("missing_close"),
        F.sum("no_vol").alias("missing_vol"),
        F.sum("bad_vol").alias("negative_vol"),
    )


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def append_after_watermark(existing: DataFrame, incoming: DataFrame, start: str = "1900-01-01") -> DataFrame:
    """Incoming rows later than the code's newest stored date."""
    marks = existing.groupBy("code").agg(F.max("dt").alias("_mark"))
    joined = incoming.join(marks, "code", "left")
    return joined.where(F.col("dt") > F.coalesce("_mark", as_day(start))).drop("_mark")


def stale_instruments(bars: DataFrame, threshold: Column) -> DataFrame:
    """Newest date per code and whether it is older than the threshold."""
    newest = bars.groupBy("code").agg(F.max("dt").alias("last_dt"), F.count(F.lit(1)).alias("n_rows"))
    return newest.withColumn("is_stale", F.col("last_dt") < threshold)


def drop_stale(bars: DataFrame, threshold: Column) -> DataFrame:
    return bars.join(stale_instruments(bars, threshold).where(~F.col("is_stale")), "code", "left_semi")


def build_universe(
    listing: DataFrame, members: DataFrame, fallback: DataFrame, excluded_name: str, fallback_key: str,
    unclassified: str = "UNCLASSIFIED",
) -> DataFrame:
    """Listing without excluded names; industry from the member table, else from the
    fallback map, else unclassified; ``is_member`` and ``source`` say which."""
    kept = listing.where(~F.col("name").rlike(excluded_name))
    joined = kept.join(members.select("code", F.col("industry").alias("_m")), "code", "left").join(
        fallback.select(fallback_key, F.col("industry").alias("_f")), fallback_key, "left"
    )
    return joined.select(
        "code",
        "name",
        F.coalesce("_m", "_f", F.lit(unclassified)).alias("industry"),
        one_if(F.col("_m").isNotNull()).alias("is_member"),
        tiers([(F.col("_m").isNotNull(), "member"), (F.col("_f").isNotNull(), "fallback")], "none").alias("source"),
    )


def group_members(members: DataFrame, industries: Sequence[str] | None = None) -> DataFrame:
    """Members per industry in code order, kept as rows so an industry of any size stays distributed."""
    if industries is not None:
        members = members.where(F.col("industry").isin(list(industries)))
    sizes = members.groupBy("industry").agg(F.count(F.lit(1)).alias("n_members"))
    return members.join(sizes, "industry").select("industry", "code", "n_members")


def enrich_parent(children: DataFrame, mapping: DataFrame) -> DataFrame:
    """Parent code and name per child from the member table; the highest member code decides."""
    parent = mapping.groupBy("child").agg(F.max_by(F.struct("parent", "parent_name"), "code").alias("_p"))
    return children.join(parent, children.code == parent.child, "left").select(
        *children.columns, F.col("_p.parent").alias("parent"), F.col("_p.parent_name").alias("parent_name")
    )


def normalise_bars(raw: DataFrame, names: dict[str, str], code: str, day: str, numbers: Sequence[str]) -> DataFrame:
    """Vendor rows to bars: rename, ``YYYY-MM-DD``/``YYYYMMDD`` text to date, code without exchange suffix, casts."""
    d = raw.withColumnsRenamed(names)
    return d.withColumns(
        {
            code: F.regexp_replace(code, r"\..*$", ""),
            day: F.to_date(F.regexp_replace(day, "-", ""), "yyyyMMdd"),
            **{n: F.col(n).cast("double") for n in numbers},
        }
    )


def listed_only(bars: DataFrame, listing: DataFrame) -> DataFrame:
    """Point-in-time universe: rows from the listing date on."""
    return bars.join(listing.select("code", "list_date"), "code").where(F.col("dt") >= F.col("list_date")).drop("list_date")


def shares_only(margin: DataFrame, code: str = "code", prefixes: Sequence[str] = NON_SHARE_PREFIXES) -> DataFrame:
    return margin.where(~F.col(code).cast("string").rlike("^(" + "|".join(prefixes) + ")"))


def without_date(df: DataFrame, day: Column) -> DataFrame:
    return df.where(F.col("dt") != day)


def feature_slice(features: DataFrame, codes: DataFrame, columns: Sequence[str], last_n: int) -> DataFrame:
    """Pruned columns of given codes over their last n distinct dates."""
    d = features.join(codes, "code", "left_semi").select("code", "dt", *columns)
    return read_recent(d, last_n)


def retain(history: DataFrame, keep_days: int = 60) -> DataFrame:
    """Rows within ``keep_days`` of the newest date."""
    return history.where(F.col("dt") >= F.date_sub(history.agg(F.max("dt")).scalar(), keep_days))


def _weekdays_until(day: Column) -> Column:
    """Weekdays since Monday 1970-01-05, the day itself included."""
    k = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def business_days_after(day: Column, until: Column) -> Column:
    """Weekdays in (day, until]."""
    return F.greatest(_weekdays_until(until) - _weekdays_until(day), F.lit(0)).cast("int")


def freshness(newest: DataFrame, now: Column, max_lag: int) -> DataFrame:
    """``newest``: (source, last_dt). Business-day lag and stale flag per source."""
    return newest.withColumn("lag_days", business_days_after(F.col("last_dt"), now)).withColumn(
        "is_stale", F.col("lag_days") > max_lag
    )


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with a running index. One row per date, so the ordering window is small."""
    return bars.select("dt").distinct().withColumn("date_idx", F.row_number().over(Window.orderBy("dt")))


def nearest_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Newest trading date at or before each day, with its index."""
    k = F.lit(1).alias("_k")
    return asof_join(days.select("*", k), calendar.select("*", k), "_k", "dt", ["date_idx"]).drop("_k").withColumnRenamed(
        "asof_dt", "trade_dt"
    )


def migrate(old: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Older table with the missing columns added as NULL."""
    return old.select("*", *[F.lit(None).cast(t).alias(n) for n, t in expected.items() if n not in old.columns])

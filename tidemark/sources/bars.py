"""Building bars from ticks, and the panels derived from the trade tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_avg, exact_sum
from ..functions.windows import lag
from .tables import table


def build_bars(ticks: DataFrame, keys: Sequence[str], price: str, qty: str, amount: str, order: Column) -> DataFrame:
    """Open/high/low/close, volume and amount per key; ``order`` is a fixed-width tick key.

    Everything is a partial aggregate, so an instrument holding a large share of the
    ticks is folded on the map side before the shuffle.
    """
    t = ticks.withColumn("_o", order)
    return t.groupBy(*keys).agg(
        F.min_by(price, "_o").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "_o").alias("close"),
        F.sum(qty).alias("vol"),
        F.sum(amount).alias("amount"),
    )


def with_change(bars: DataFrame, key: str = "code") -> DataFrame:
    w = Window.partitionBy(key).orderBy("dt")
    return bars.withColumn("pre_close", lag("close", 1, w)).withColumn(
        "pct_chg", (F.col("close") / F.col("pre_close") - 1) * 100
    )


def trade_ticks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("amt"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def tick_order() -> Column:
    """(order, line, part) as one number: fixed width keeps the bar build a hash aggregate."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    return line * F.lit(10**13).cast("decimal(14,0)") + F.col("l_partkey").cast("decimal(14,0)")


def instrument_bars(spark: SparkSession, base: str) -> DataFrame:
    """Instrument = supplier, one bar per supplier and ship day. Amounts are added in whole 1/10,000, so that equal
    amounts stay equal whatever the order of the ticks."""
    t = trade_ticks(spark, base).withColumn("amt", F.floor(F.col("amt") * 1e4 + 0.5))
    b = build_bars(t, ["code", "dt"], "px", "qty", "amt", tick_order())
    return b.withColumn("amount", F.col("amount").cast("double") / 1e4)


def instrument_panel(spark: SparkSession, base: str) -> DataFrame:
    return with_change(instrument_bars(spark, base))


def members(spark: SparkSession, base: str) -> DataFrame:
    """Instrument to industry dimension: l1 = region, l2 = nation."""
    s = table(spark, base, "supplier")
    n = table(spark, base, "nation")
    r = table(spark, base, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("code"),
            F.col("s_name").alias("name"),
            F.col("r_regionkey").cast("long").alias("l1"),
            F.col("r_name").alias("l1_name"),
            F.col("n_nationkey").cast("long").alias("l2"),
            F.col("n_name").alias("l2_name"),
        )
    )


def _industry_ticks(spark: SparkSession, base: str) -> DataFrame:
    return trade_ticks(spark, base).join(members(spark, base).drop("name"), "code").drop("code")


def l2_bars(spark: SparkSession, base: str) -> DataFrame:
    """Nation per day with its region as parent."""
    t = _industry_ticks(spark, base).withColumnsRenamed({"l2": "code", "l2_name": "name", "l1": "parent", "l1_name": "parent_name"})
    return build_bars(t, ["code", "name", "parent", "parent_name", "dt"], "px", "qty", "amt", tick_order())


def l1_bars(spark: SparkSession, base: str) -> DataFrame:
    """Region per day."""
    t = _industry_ticks(spark, base).withColumnsRenamed({"l1": "code", "l1_name": "name"})
    return build_bars(t, ["code", "name", "dt"], "px", "qty", "amt", tick_order())


def week_bars(spark: SparkSession, base: str) -> DataFrame:
    """Nation per ISO week: bars with real ranges, for range-based indicators."""
    t = _industry_ticks(spark, base).select(
        F.col("l2").alias("code"), F.to_date(F.date_trunc("week", "dt")).alias("dt"), "px", "qty", "amt",
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    return build_bars(t, ["code", "dt"], "px", "qty", "amt", tick_order())


def week_panel(spark: SparkSession, base: str) -> DataFrame:
    return with_change(week_bars(spark, base))


def moneyflow(spark: SparkSession, base: str) -> DataFrame:
    """Buy and sell amounts per instrument and day, by line status."""
    amt = F.col("l_extendedprice")
    buy = exact_sum(F.when(F.col("l_linestatus") == "O", amt).otherwise(0.0))
    sell = exact_sum(F.when(F.col("l_linestatus") == "F", amt).otherwise(0.0))
    return (
        table(spark, base, "lineitem")
        .groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("dt"))
        .agg(buy.alias("buy_elg_amount"), sell.alias("sell_elg_amount"))
        .withColumn("net_mf_amount", F.col("buy_elg_amount") - F.col("sell_elg_amount"))
    )


def margin(spark: SparkSession, base: str) -> DataFrame:
    """Margin purchases and running balance per instrument and day, by return flag."""
    amt = F.col("l_extendedprice")
    w = Window.partitionBy("code").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    daily = (
        table(spark, base, "lineitem")
        .groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            exact_sum(F.when(F.col("l_returnflag") == "A", amt).otherwise(0.0)).alias("rzmre"),
            exact_sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(0.0)).alias("rzche"),
        )
    )
    return daily.select(
        "code", "dt", "rzmre", "rzche", exact_sum(F.col("rzmre") - F.col("rzche"), over=w).alias("rzye")
    )


def valuation(spark: SparkSession, base: str) -> DataFrame:
    """Monthly valuation rows per instrument, dated at the first day of the month."""
    li = table(spark, base, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.groupBy(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt"))
        .agg(
            (exact_avg(px) / F.nullif(exact_avg("l_discount") * 1000, F.lit(0.0))).alias("pe_ttm"),
            (exact_avg(px) / 1000).alias("pb"),
            (exact_avg("l_tax") * 100).alias("roe"),
            (exact_avg("l_discount") * 100).alias("gross_margin"),
            (exact_avg("l_quantity") / 5).alias("ar_turn"),
            exact_sum("l_extendedprice").alias("total_mv"),
        )
    )


def statements(spark: SparkSession, base: str) -> DataFrame:
    """Annual statement per instrument and year from the order lines."""
    li = table(spark, base, "lineitem")
    amt = F.col("l_extendedprice")
    year_end = F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31))
    return (
        li.groupBy(F.col("l_suppkey").alias("code"), year_end.alias("end_date"))
        .agg(
            exact_sum(amt).alias("revenue"),
            exact_sum(amt * (F.col("l_discount") - F.col("l_tax"))).alias("n_income"),
            exact_sum(amt * F.col("l_discount")).alias("cfo"),
            exact_sum(amt * F.col("l_tax")).alias("capex"),
            exact_sum(F.when(F.col("l_linestatus") == "O", amt).otherwise(0.0)).alias("receivables"),
        )
        .withColumn("fcf", F.col("cfo") - F.col("capex"))
        .withColumn("report_type", F.lit("1"))
    )


# B9: pseudo probabilities; three seeds stand for three engines.
ENGINE_SEEDS = {"momentum": (7919, 104729), "reversion": (6007, 15487), "breakout": (3571, 86028)}


def with_engine_scores(bars: DataFrame) -> DataFrame:
    """Deterministic win probabilities of three engines per (instrument, day) plus forward returns, for bars with a close."""
    w = Window.partitionBy("code").orderBy("dt")
    n = F.datediff("dt", F.lit("1995-01-01").cast("date")).cast("long")
    probs = [
        (((F.col("code") * a + n * b) % 1000) / 1000.0).alias(f"p_{e}") for e, (a, b) in ENGINE_SEEDS.items()
    ]
    return bars.select(
        "*", *probs,
        ((F.lead("close", 1).over(w) / F.col("close") - 1) * 100).alias("t1_ret"),
        ((F.lead("close", 5).over(w) / F.col("close") - 1) * 100).alias("d5_ret"),
        ((F.lead("close", 20).over(w) / F.col("close") - 1) * 100).alias("fwd_ret"),
    )


def engine_scores(spark: SparkSession, base: str) -> DataFrame:
    return with_engine_scores(instrument_bars(spark, base).select("code", "dt", "close", "vol", "amount"))

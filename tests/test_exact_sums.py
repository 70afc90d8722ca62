"""Sums that queries rank by, divide by or compare do not depend on the order of the rows."""

import datetime as dt
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import load
from tidemark.functions.scalar import exact_avg, exact_sum
from tidemark.operators import flows, industry as iops, market as mkt, studies as st
from tidemark.sources import bars as src

UP, DOWN = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Three suppliers of one nation; two have the same three lines on a day, in another order."""
    base = str(tmp_path_factory.mktemp("tied"))
    lines = []
    for code, prices in ((1, UP), (2, DOWN), (3, (0.1, 0.1, 5.0))):
        for i, p in enumerate(prices):
            lines.append((code * 10 + i, i, code, i + 1, 1.0, p, p / 10, 0.05, "A", "O", dt.datetime(1995, 1, 2)))
        lines.append((code * 10 + 9, 9, code, 7, 1.0, 0.7, 0.1, 0.05, "A", "F", dt.datetime(1995, 1, 2)))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"{base}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}", 0, 1.0) for k in (1, 2, 3)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{base}/supplier.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{base}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{base}/region.parquet")
    return base


def test_sums_and_means_ignore_order(spark):
    d = spark.createDataFrame([(k, x) for k, v in (("u", UP), ("d", DOWN)) for x in (*v, float("nan"), None)], "k string, x double").coalesce(1)
    got = {tuple(r)[1:] for r in d.groupBy("k").agg(exact_sum("x"), exact_avg("x")).collect()}
    assert got == {(0.6, 0.6 / 3)}


@pytest.mark.parametrize("name,column", [("flow_features", "mf_intensity_rank"), ("valuation_features", "pb_industry_percentile"), ("rank_features", "rank_amount"), ("fundamental_score", "pb_bonus")])
def test_equal_sums_share_a_rank(spark, tied, name, column):
    got = {r.code: r[column] for r in load().queries[name](spark, tied).collect()}
    assert got[1] == got[2] != got[3]


def test_equal_industry_means_share_a_rank(spark):
    rows = [(i * 10 + j, x) for i, v in enumerate((*permutations(UP), (3.0, 3.0, 3.0))) for j, x in enumerate(v)]
    panel = spark.createDataFrame(rows, "code long, pct_chg double").withColumn("dt", F.lit("2020-01-01").cast("date")).coalesce(1)
    members = panel.select("code", F.floor(F.col("code") / 10).alias("l2"))
    got = {r.l2: r.ind_rank for r in iops.industry_day(panel, members, "l2").collect()}
    assert got == {**dict.fromkeys(range(6), 50.0), 6: 100.0}


def test_a_balance_repaid_in_full_is_zero(spark, tmp_path):
    lines = [(1, 0.1, "A", 1), (2, 0.2, "A", 2), (3, 0.3, "R", 3), (4, 0.5, "A", 4)]
    lines = [(k, k, 1, 1, 1.0, p, 0.0, 0.0, f, "O", dt.datetime(1995, 1, d)) for k, p, f, d in lines]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = flows.margin_features(src.margin(spark, str(tmp_path))).orderBy("dt").collect()
    assert [r.rzye for r in d] == [0.1, 0.3, 0.0, 0.5] and d[-1].margin_balance_change == 0.0


def test_market_sums_ignore_order(spark):
    rows = [(dt.date(2020, 1, i + 1), float(x)) for i, v in enumerate((UP, DOWN)) for x in v]
    d = spark.createDataFrame(rows, "dt date, rzye double").withColumns({"rzmre": F.lit(0.0), "rzche": F.lit(0.0)}).coalesce(1)
    assert {r.rzye for r in mkt.margin_totals(d).collect()} == {0.6}


def test_anomaly_at_exactly_two_deviations_is_normal(spark):
    k = [3, 1, 0, 0, 2, 0, 2, 0, 1, 0, 3, 1, 3, 3, 3, 1, 2, 3, 1, 3, 4]  # z of the last is 2, and 2.0000000000000004 in doubles
    d = spark.createDataFrame([(dt.date(2020, 1, i + 1), v / 7 * 100) for i, v in enumerate(k)], "dt date, x double")
    last = st.anomaly_scores(d, "x").orderBy(F.desc("dt")).first()
    assert (last.z, last.level) == (2.0, "normal")

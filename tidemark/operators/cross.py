"""Cross-sectional operators per date or group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles, with_group_stats, with_place
from ..functions.scalar import div0, tiers


def zscores(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], fill: float = 0.0) -> DataFrame:
    """(x - mean) / sample deviation per group; ``fill`` where the deviation vanishes."""
    stats = [e for o, s in columns.items() for e in (F.avg(s).alias(f"_m_{o}"), F.stddev_samp(s).alias(f"_s_{o}"))]
    d = with_group_stats(df, by, *stats)
    z = {
        o: F.when(F.col(s).isNotNull(), F.when(F.col(f"_s_{o}") > 1e-10, div0(F.col(s) - F.col(f"_m_{o}"), f"_s_{o}")).otherwise(F.lit(fill)))
        for o, s in columns.items()
    }
    return d.withColumns(z).drop(*[f"_{k}_{o}" for o in columns for k in "ms"])


def minmax(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], top: float = 10.0, flat: float = 5.0) -> DataFrame:
    """Scaled to 0..top inside each group; a constant group gets ``flat``."""
    stats = [e for o, s in columns.items() for e in (F.min(s).alias(f"_l_{o}"), F.max(s).alias(f"_h_{o}"))]
    d = with_group_stats(df, by, *stats) if by else df.withColumn("_one", F.lit(1))
    if not by:
        d = with_group_stats(d, ["_one"], *stats).drop("_one")
    scaled = {
        o: F.when(F.col(f"_h_{o}") - F.col(f"_l_{o}") < 1e-10, F.lit(flat)).otherwise(
            div0(F.col(s) - F.col(f"_l_{o}"), F.col(f"_h_{o}") - F.col(f"_l_{o}")) * top
        )
        for o, s in columns.items()
    }
    return d.withColumns(scaled).drop(*[f"_{k}_{o}" for o in columns for k in "lh"])


def top_n(df: DataFrame, by: Sequence[str], x: str, n: int, tie: str = "code", largest: bool = True, out: str = "rk") -> DataFrame:
    """n largest (smallest) per group with an explicit tie-break; Spark limits inside the map side."""
    order = F.desc_nulls_last(x) if largest else F.asc_nulls_last(x)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where(F.col(out) <= n)


def size_groups(bars: DataFrame) -> DataFrame:
    """micro / mid / large by the thirds of each code's mean amount."""
    amounts = bars.groupBy("code").agg(F.avg("amount").alias("avg_amount"))
    q = exact_percentiles(amounts, [], "avg_amount", {"q1": 1 / 3, "q2": 2 / 3})
    a = F.col("avg_amount")
    label = tiers([(a <= q.select("q1").scalar(), "micro"), (a <= q.select("q2").scalar(), "mid")], "large")
    return amounts.withColumn("size_group", label)


def top_share_boost(df: DataFrame, by: Sequence[str], x: str, share: float = 0.03, factor: float = 1.1, score: str = "composite_score") -> DataFrame:
    """Flag the top ceil(share * n) rows of x per group (at least one) and scale their score."""
    v = F.col(x).cast("double")
    missing = v.isNull() | F.isnan(v)
    d = with_place(df, by, [missing, F.when(~missing, -v), F.col("code")], "_rk", "_n")
    d = d.withColumn("momentum_boost", F.col("_rk") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1)))
    return d.withColumn(score, F.when(F.col("momentum_boost"), F.col(score) * factor).otherwise(F.col(score))).drop("_rk", "_n")

"""Newest row per instrument, alone or as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, asof: Column | None = None, min_rows: int = 1, key: str = "code") -> DataFrame:
    """One row per key: the newest (not later than ``asof``), keys with fewer rows dropped.

    A grouped ``max_by`` combines on the map side, unlike ranking each key's rows.
    """
    if asof is not None:
        df = df.where(F.col("dt") <= asof)
    newest = df.groupBy(key).agg(
        F.max_by(F.struct(*df.columns), "dt").alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    return newest.where(F.col("_n") >= min_rows).select("_r.*")

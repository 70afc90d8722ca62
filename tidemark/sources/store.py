"""Writing results and keeping the feature store up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The longest feature window, in a code's own bars.
BUFFER_BARS = 250


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("dt"))


def write_store(df: DataFrame, path: str) -> None:
    """Year-partitioned Parquet; only the years present in ``df`` are replaced."""
    with_year(df).repartition("year", F.hash("code") % 64).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("year").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_feature_rows(bars: DataFrame, build, last: Column, buffer_bars: int = BUFFER_BARS) -> DataFrame:
    """Features of dates after ``last``, computed on those bars and the ``buffer_bars`` before them of each code,
    however far back those lie. Exact for windows of up to so many bars; features that remember more
    (smoothing, running sums, run lengths) belong into a store that is carried forward (``sources.carried``)."""
    newest = Window.partitionBy("code").orderBy(F.desc("dt"))
    before = bars.where(F.col("dt") <= last).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= buffer_bars).drop("_k")
    return build(before.unionByName(bars.where(F.col("dt") > last))).where(F.col("dt") > last)


def update_store(spark: SparkSession, path: str, bars: DataFrame, build, buffer_bars: int = BUFFER_BARS) -> None:
    """Append the dates the store lacks."""
    last = read_store(spark, path).agg(F.max("dt").alias("d")).scalar()
    with_year(new_feature_rows(bars, build, last, buffer_bars)).write.mode("append").partitionBy("year").parquet(path)


def remove_date(spark: SparkSession, path: str, day: str, staging: str) -> None:
    """Drop one date: the year it lies in is rewritten, other years stay untouched."""
    year = int(day[:4])
    kept = read_store(spark, path).where((F.col("year") == year) & (F.col("dt") != F.lit(day).cast("date")))
    kept.write.mode("overwrite").partitionBy("year").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year"
    ).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)

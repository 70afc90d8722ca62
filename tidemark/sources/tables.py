"""Reading of the base tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import nan_to_null


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN marks a missing number in vendor files; inside the library it is NULL."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[nan_to_null(n).alias(n) if n in doubles else n for n in df.columns])

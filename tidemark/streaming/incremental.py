"""Daily append as a file stream: new bar files land in a folder and are appended once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.ingest import append_new


def append_stream(spark: SparkSession, landing: str, schema: StructType, store: str, state: str, keys=("code", "dt")) -> StreamingQuery:
    """Append files of ``landing`` to the Parquet ``store``, keys already stored are skipped.

    The key check makes a replayed batch harmless.
    """

    def write(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(schema).parquet(store)
        append_new(stored, batch, list(keys)).write.mode("append").parquet(store)

    source = spark.readStream.schema(schema).parquet(landing)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def stored_keys(spark: SparkSession, store: str, schema: StructType, years: list[int], keys=("code", "dt")) -> DataFrame:
    """Keys of a store partitioned by ``year``, read from the given years only."""
    return spark.read.schema(StructType([*schema.fields, StructField("year", IntegerType())])).parquet(store).where(F.col("year").isin(years)).select(*keys)


def append_stream_by_year(spark: SparkSession, landing: str, schema: StructType, store: str, state: str, keys=("code", "dt")) -> StreamingQuery:
    """Append files of ``landing`` to a store partitioned by the year of ``dt``, each key once.

    A batch is compared with the years it touches, not with the whole store, so replayed files are harmless, and
    bars that arrive late, however late, still find their year. Rows without a date are left out. The driver
    reads the distinct years of a batch. The store is created if it is not there.
    """

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.where("dt is not null").withColumn("year", F.year("dt")).persist()
        years = [r.year for r in rows.select("year").distinct().collect()]
        path = session._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(path):
            fresh = append_new(stored_keys(session, store, schema, years, keys), rows, list(keys))
        else:
            fresh = rows.dropDuplicates(list(keys))
        if years:
            fresh.write.mode("append").partitionBy("year").parquet(store)
        rows.unpersist()

    source = spark.readStream.schema(schema).parquet(landing)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()

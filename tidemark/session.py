"""Session settings and the durable cut points used by iterative work."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the launcher's own settings win: only the adaptive planner and the
    UTC calendar are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
        builder = builder.config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A session on one machine
    that lacks the setting gets a temporary folder of its own; a cluster session without it
    is an error, since executors could not read a folder of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_FOLDERS[app]


def materialised(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder.

    Lost executors read it again instead of recomputing, and later stages read only the
    columns they use. ``discard`` removes the table once nothing reads it any more.

    ``large_rows``: for rows of some MB, each a row group of its own. A writer holds a row group (and
    looks at its size only every 100 rows), and a reader decodes one at once.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if large_rows:
        writer = writer.option("parquet.block.row.count.limit", 1)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialised`` that no later job reads."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from {code: closes}, one per calendar day; open/high/low follow the close."""
    import datetime as dt

    def make(series, vol=100.0):
        rows = []
        for code, closes in series.items():
            for i, c in enumerate(map(float, closes)):
                v = vol[code][i] if isinstance(vol, dict) else vol
                rows.append((code, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c * 1.02, c * 0.98, c, v, c * v))
        return spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, vol double, amount double")

    return make

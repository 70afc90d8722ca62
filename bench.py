"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import load
from tidemark.session import build_session

HEADLINE = (
    "momentum", "moving_average", "return_statistics", "macd", "rsi", "streaks", "leading_signals", "industry_zone",
    "regime", "fragility", "cross_section_ranks", "rank_ic", "route_portfolio", "topn_backtest", "stop_loss_study",
    "feature_matrix",
)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    reg = load().queries
    spark.read.parquet(os.path.join(base, "lineitem.parquet")).count()
    times = {}
    for name in HEADLINE:
        if name not in reg:
            continue
        t0 = time.time()
        reg[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

"""Models refitted every week on the weeks before, all weeks side by side.

Each week has its own training window and is validated on the week itself. The fits are ridge
regressions: what a fit needs are sums of products of its rows, so all weeks are fitted by one
aggregation, whatever the number of rows in a window, and solved as small systems, one a week.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.studies import rank_ic


def weekly_windows(days: DataFrame, weeks: int = 12) -> DataFrame:
    """(week, train_start, train_end, val_start, val_end) of every week (named by its Monday) with dates: it is validated on
    its own dates and trained on the ``weeks`` weeks before. Weeks for which ``days`` does not reach back so far are left out."""
    week = F.to_date(F.date_trunc("week", "dt")).alias("week")
    d = days.select("dt").distinct().groupBy(week).agg(F.min("dt").alias("val_start"), F.max("dt").alias("val_end"))
    first = d.agg(F.min("week")).scalar()
    d = d.where(F.date_sub("week", 7 * weeks) >= first)
    return d.select("week", F.date_sub("week", 7 * weeks).alias("train_start"), F.date_sub("week", 1).alias("train_end"), "val_start", "val_end")


def with_outcome_date(bars: DataFrame, horizon: int) -> DataFrame:
    """Adds ``end_dt``, the date of the row a label looks ahead to."""
    return bars.withColumn("end_dt", F.lead("dt", horizon).over(Window.partitionBy("code").orderBy("dt")))


def window_rows(data: DataFrame, windows: DataFrame, weeks: int = 12) -> DataFrame:
    """Rows of ``data`` (dt, end_dt, ...) once for each ``week`` whose training they belong to: in its window and with an outcome known
    before its validation. The weeks a row can train follow from its date."""
    own = F.to_date(F.date_trunc("week", "dt"))
    each = data.where("end_dt is not null").withColumn("week", F.explode(F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.date_add(own, (k * 7).cast("int")))))
    return each.where(F.col("end_dt") < F.col("week")).join(windows.select("week"), "week", "left_semi")


def validation_rows(data: DataFrame, windows: DataFrame) -> DataFrame:
    return data.withColumn("week", F.to_date(F.date_trunc("week", "dt"))).join(windows.select("week"), "week", "left_semi")


def window_counts(data: DataFrame, windows: DataFrame, label: str, weeks: int = 12) -> DataFrame:
    """The windows with their labelled rows for training and validation."""
    count = lambda d, name: d.where(F.col(label).isNotNull()).groupBy("week").agg(F.count(F.lit(1)).alias(name))
    d = windows.join(count(window_rows(data, windows, weeks), "n_train"), "week", "left").join(count(validation_rows(data, windows), "n_val"), "week", "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_train", "n_val")})


def weekly_ridge(train: DataFrame, columns: Sequence[str], label: str, penalty: float = 1.0, min_rows: int = 100) -> DataFrame:
    """(week, n_rows, intercept, weights) of the ridge regression of ``label`` on ``columns`` (NULL: 0) for every week with
    ``min_rows`` labelled rows or more. The intercept is not penalised."""
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = [F.sum(v * F.col(label)).alias(f"t{i}") for i, v in enumerate(x)]
    d = train.where(F.col(label).isNotNull()).groupBy("week").agg(F.count(F.lit(1)).alias("n_rows"), *sums, *moments).where(F.col("n_rows") >= min_rows)

    def solve(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = row[f"s{i}_{j}"]
                a[range(1, k), range(1, k)] += penalty
                w = np.linalg.lstsq(a, np.array([row[f"t{i}"] for i in range(k)]), rcond=None)[0]
                out.append((row["week"], row["n_rows"], float(w[0]), w[1:].tolist()))
            yield pd.DataFrame(out, columns=["week", "n_rows", "intercept", "weights"])

    return d.mapInPandas(solve, "week date, n_rows long, intercept double, weights array<double>")


def scored(rows: DataFrame, fits: DataFrame, columns: Sequence[str], out: str = "pred") -> DataFrame:
    """Validation rows (with ``week``) scored by their week's fit; weeks without one are left out."""
    value: Column = F.col("_f.intercept")
    for i, c in enumerate(columns):
        value = value + F.col("_f.weights")[i] * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    d = rows.join(fits.select("week", F.struct("intercept", "weights").alias("_f")), "week")
    return d.withColumn(out, value).drop("_f")


def weekly_ic(predictions: DataFrame, pred: str, actual: str, boost: float = 2.0, min_rows: int = 10) -> DataFrame:
    """Per week: rows, plain rank IC and the one with predictions scaled where the outcome is a gain (``rank_ic``), and the share of
    gains among rows predicted above their week's mean. The whole week is one ranking."""
    by = predictions.select("week", F.concat_ws("|", "code", "dt").alias("code"), pred, actual)
    plain = rank_ic(by, pred, actual, by="week", min_rows=min_rows).select("week", "n", F.col("ic").alias("ic_plain"))
    boosted = rank_ic(by, pred, actual, by="week", min_rows=min_rows, boost=boost).select("week", F.col("ic").alias("ic_boosted"))
    known = by.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    mean = known.groupBy("week").agg(F.round(F.avg(pred), 9).alias("_m"))
    wins = known.join(mean, "week").where(F.col(pred) > F.col("_m")).groupBy("week").agg(F.avg((F.col(actual) > 0).cast("int")).alias("win_rate"))
    return plain.join(boosted, "week", "left").join(wins, "week", "left")

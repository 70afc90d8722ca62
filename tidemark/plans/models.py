"""Labels, models and walk-forward evaluation with pyspark.ml tree ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import one_if, rd, tiers
from ..functions.windows import lead
from ..operators.studies import auc, rank_ic, topn_panel
from ..session import materialised
from ..sources.ingest import trading_calendar

# Label borders in percent and the weight of losing samples.
LOSS, GAIN, LOSS_WEIGHT = -2.0, 2.0, 2.0


def ordinal_labels(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """0 / 1 / 2 by the forward return, NULL without one; losing samples weigh double."""
    d = bars.withColumn("fwd_ret", rd((lead("close", horizon) / F.col("close") - 1) * 100))
    y = F.when(F.col("fwd_ret") < LOSS, 0).when(F.col("fwd_ret") > GAIN, 2).when(F.col("fwd_ret").isNotNull(), 1)
    return d.withColumn("y_label", y).withColumn("weight", F.when(F.col("y_label") == 0, LOSS_WEIGHT).when(F.col("y_label").isNotNull(), 1.0))


def sector_targets(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Mean of the next ``horizon`` returns per industry, its tercile on the date, and whether it beats the median."""
    from ..functions.ranks import exact_percentiles
    from ..functions.windows import momentum, next_n

    d = bars.withColumn("_r", momentum(1)).withColumn("fwd_mean", F.when(F.count("_r").over(next_n(horizon)) >= horizon, F.avg("_r").over(next_n(horizon))))
    d = d.where("fwd_mean is not null")
    edges = exact_percentiles(d, ["dt"], "fwd_mean", {"_q1": 1 / 3, "_q2": 2 / 3, "_med": 0.5})
    d = d.join(edges, "dt")
    third = tiers([(F.col("fwd_mean") <= F.col("_q1"), 0), (F.col("fwd_mean") <= F.col("_q2"), 1)], 2)
    return d.select("code", "dt", "fwd_mean", third.alias("tercile"), one_if(F.col("fwd_mean") > F.col("_med")).alias("outperform"))


def market_targets(index: DataFrame, horizon: int = 20) -> DataFrame:
    """Direction of the index over the next ``horizon`` dates, NULL at the end."""
    f = lead("close", horizon) / F.col("close") - 1
    return index.select("dt", "close", (f * 100).alias("fwd_ret"), F.when(f.isNotNull(), one_if(f > 0)).alias("fwd_dir"))


def _assembled(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")


def fit_engine(train: DataFrame, columns: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Three-class forest on the ordinal label with sample weights."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="y_label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembled(columns), rf]).fit(train.where("y_label is not null"))


def win_probability(model: PipelineModel, rows: DataFrame, out: str = "win_prob") -> DataFrame:
    """Probability of the gain class."""
    return model.transform(rows).withColumn(out, vector_to_array("probability")[2]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")


def fit_regressor(train: DataFrame, columns: Sequence[str], label: str = "fwd_ret", rounds: int = 10, depth: int = 4, seed: int = 7) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembled(columns), gbt]).fit(train.where(F.col(label).isNotNull()))


def fit_group_regressors(train: DataFrame, groups: DataFrame, columns: Sequence[str], **kw) -> dict[str, PipelineModel]:
    """One forward-return regressor per size group; small instruments get shallower trees."""
    out = {}
    for g in ("micro", "mid", "large"):
        part = train.join(groups.where(F.col("size_group") == g).select("code"), "code", "left_semi")
        out[g] = fit_regressor(part, columns, depth=3 if g == "micro" else 4, **kw)
    return out


def fit_direction(train: DataFrame, columns: Sequence[str], label: str, rounds: int = 10, depth: int = 3, seed: int = 7) -> PipelineModel:
    """Binary classifier of the market direction or industry outperformance."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembled(columns), gbt]).fit(train.where(F.col(label).isNotNull()))


def fold_ranges(days: DataFrame, train0: int, val: int, step: int, gap: int = 20) -> DataFrame:
    """Expanding-window folds over date positions with ``gap`` dates between training and
    validation; too short a calendar has no fold."""
    cal = trading_calendar(days)
    last = cal.agg(F.max("date_idx").alias("n"))
    # one row per fold
    long = last.where(F.col("n") - val - gap >= train0)
    return long.select(F.explode(F.sequence(F.lit(train0), F.col("n") - val - gap, F.lit(step))).alias("train_end")).select(
        (F.row_number().over(Window.orderBy("train_end")) - 1).alias("fold"), "train_end", (F.col("train_end") + gap + 1).alias("val_first"), (F.col("train_end") + gap + val).alias("val_last"),
    )


def with_label_end(labelled: DataFrame, horizon: int) -> DataFrame:
    """Adds date_idx and end_idx, the date position of the row a label looks ahead to."""
    cal = trading_calendar(labelled)
    d = labelled.withColumn("_end", F.lead("dt", horizon).over(Window.partitionBy("code").orderBy("dt")))
    ends = cal.select(F.col("dt").alias("_end"), F.col("date_idx").alias("end_idx"))
    return d.join(cal, "dt").join(ends, "_end", "left").drop("_end")


def training_rows(data: DataFrame, train_end: int, val_first: int) -> DataFrame:
    return data.where((F.col("date_idx") <= train_end) & (F.col("end_idx") < val_first))


def walk_forward(labelled: DataFrame, columns: Sequence[str], train0: int, val: int, step: int, gap: int = 20, trees: int = 10, depth: int = 4, horizon: int = 20) -> DataFrame:
    """Out-of-sample probabilities of every fold. A label looks ``horizon`` rows of its code
    ahead, which may span many more dates; a fold trains on labels that end before its validation. Fits run fold by fold, each on the cluster;
    the fold table (a row per fold) is the only thing read by the driver."""
    data = materialised(with_label_end(labelled, horizon))
    parts = []
    for f in fold_ranges(data, train0, val, step, gap).collect():
        model = fit_engine(training_rows(data, f.train_end, f.val_first), columns, trees, depth)
        rows = data.where(F.col("date_idx").between(f.val_first, f.val_last))
        parts.append(materialised(win_probability(model, rows).select("code", "dt", "fwd_ret", "y_label", "win_prob", *[c for c in ("atr_pct",) if c in rows.columns]).withColumn("fold", F.lit(f.fold))))
    return reduce(DataFrame.unionByName, parts)


def evaluate_folds(predictions: DataFrame) -> DataFrame:
    """Per fold: rows, mean rank IC, AUC of the gain class, daily top-5 win rate."""
    ic = rank_ic(predictions, "win_prob", "fwd_ret").join(predictions.select("dt", "fold").distinct(), "dt").groupBy("fold").agg(F.avg("ic").alias("rank_ic"), F.count(F.lit(1)).alias("n_dates"))
    labelled = predictions.where("y_label is not null").withColumn("y", one_if(F.col("y_label") == 2))
    size = predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))
    return size.join(ic, "fold", "left").join(auc(labelled, "win_prob", "y", ["fold"]).select("fold", "auc"), "fold", "left")


def summary(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("rank_ic").alias("mean_ic"), F.stddev_samp("rank_ic").alias("ic_std"), F.avg(one_if(F.col("rank_ic") > 0)).alias("positive_share"), F.avg("auc").alias("mean_auc"),
    )


def top_panel(predictions: DataFrame, n: int = 5) -> DataFrame:
    return topn_panel(predictions, "win_prob", "fwd_ret", "atr_pct", n)


def rerank(picks: DataFrame, newest: DataFrame, models: dict[str, PipelineModel], groups: DataFrame) -> DataFrame:
    """Predicted return of each pick's newest row by its group's model, scaled to 0..10 and ranked; unscored picks come last."""
    from ..operators.cross import minmax

    rows = newest.join(picks.select("code"), "code", "left_semi").join(groups.select("code", "size_group"), "code")
    parts = [m.transform(rows.where(F.col("size_group") == g)).select("code", F.col("prediction").alias("ml_pred")) for g, m in models.items()]
    d = picks.join(reduce(DataFrame.unionByName, parts), "code", "left")
    d = minmax(d, [], {"ml_score": "ml_pred"})
    return d.withColumn("ml_score", F.when(F.col("ml_pred").isNotNull(), F.col("ml_score"))).orderBy(F.desc_nulls_last("ml_score"), "code")


# ---- stored models ---------------------------------------------------------------------------


def save_model(model: PipelineModel, root: str, engine: str, asof: str) -> str:
    path = f"{root}/{engine}/asof={asof}"
    model.write().overwrite().save(path)
    return path


def stored_dates(spark: SparkSession, root: str, engine: str) -> list[str]:
    """Dates of the stored versions, listed through the session's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{engine}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("asof="))


def load_model(spark: SparkSession, root: str, engine: str, asof: str | None = None) -> PipelineModel | None:
    """Newest version, or the newest not later than ``asof``."""
    dates = [d for d in stored_dates(spark, root, engine) if asof is None or d <= asof]
    return PipelineModel.load(f"{root}/{engine}/asof={dates[-1]}") if dates else None


def is_stale(spark: SparkSession, root: str, engine: str, newest_data: str) -> bool:
    dates = stored_dates(spark, root, engine)
    return not dates or dates[-1] < newest_data



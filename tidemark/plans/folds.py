"""One fold engine for all walk-forward models, and rule forecasters that run beside them.

Folds expand: fold k trains on the dates up to ``train0 + k * step``, leaves ``gap`` dates out and
is validated on the ``val`` dates after. A row trains a fold only if what its label looks ahead to ends before the
validation. Which folds a row belongs to is arithmetic on its date position, so counts and
validation rows of all folds come from one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nz, one_if, tiers
from ..operators.studies import auc
from ..session import materialised
from ..sources.ingest import trading_calendar
from .models import fit_direction, fold_ranges, training_rows, with_label_end


@dataclass(frozen=True)
class FoldPlan:
    train0: int
    val: int
    step: int
    gap: int = 20
    horizon: int = 20


def folds(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """fold, train_end, val_first, val_last as date positions and as dates (``_dt``): a row per fold."""
    cal = trading_calendar(days)
    out = fold_ranges(days, plan.train0, plan.val, plan.step, plan.gap)
    for c in ("train_end", "val_first", "val_last"):
        out = out.join(cal.select(F.col("date_idx").alias(c), F.col("dt").alias(f"{c}_dt")), c)
    return out


def placed(labelled: DataFrame, plan: FoldPlan) -> DataFrame:
    """``labelled`` (code, dt, ...) with the position of its date and of the date its label looks ahead to."""
    return with_label_end(labelled, plan.horizon)


def first_fold(plan: FoldPlan) -> Column:
    """The first fold a placed row trains (all later ones follow); NULL without a label end."""
    needs = F.greatest(F.col("date_idx") - plan.train0, F.col("end_idx") - plan.gap - plan.train0)
    return F.when(F.col("end_idx").isNotNull(), F.greatest(F.ceil(needs / plan.step), F.lit(0))).cast("int")


def validation_rows(data: DataFrame, plan: FoldPlan, n_folds: int) -> DataFrame:
    """Placed rows with the ``fold`` they validate; one that lies in several validations is repeated."""
    low = F.ceil((F.col("date_idx") - plan.val - plan.gap - plan.train0) / plan.step)
    high = F.floor((F.col("date_idx") - plan.gap - 1 - plan.train0) / plan.step)
    low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n_folds - 1)).cast("int")
    return data.withColumn("fold", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))


def fold_counts(data: DataFrame, days: DataFrame, plan: FoldPlan, label: str) -> DataFrame:
    """Bounds of every fold with its rows for training and validation that have the label."""
    known = data.where(F.col(label).isNotNull())
    bounds = materialised(folds(days, plan))
    n = bounds.count()
    enters = known.groupBy(first_fold(plan).alias("fold")).agg(F.count(F.lit(1)).alias("_n"))
    sofar = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)  # a row per fold
    train = bounds.join(enters, "fold", "left").withColumn("n_train", F.coalesce(F.sum("_n").over(sofar), F.lit(0))).drop("_n")
    val = validation_rows(known, plan, n).groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"))
    return train.join(val, "fold", "left").withColumn("n_val", F.coalesce("n_val", F.lit(0)))


def walk_forward_direction(data: DataFrame, days: DataFrame, plan: FoldPlan, columns: Sequence[str], label: str, keep: Sequence[str] = (), rounds: int = 10, depth: int = 3, min_train: int = 100, min_val: int = 10) -> DataFrame:
    """Out-of-sample probabilities of a 0/1 label in every fold that has enough rows (fold, code, dt,
    label, prob, ``keep``). The driver reads the fold table (a row per fold) and fits fold by fold, each on the cluster."""
    data = materialised(data.withColumns({c: nz(c) for c in columns}))
    parts = []
    for f in fold_counts(data, days, plan, label).orderBy("fold").collect():
        if f.n_train < min_train or f.n_val < min_val:
            continue
        model = fit_direction(training_rows(data, f.train_end, f.val_first), columns, label, rounds, depth)
        rows = data.where(F.col("date_idx").between(f.val_first, f.val_last) & F.col(label).isNotNull())
        scored = model.transform(rows).withColumn("prob", vector_to_array("probability")[1])
        parts.append(materialised(scored.select(F.lit(f.fold).alias("fold"), "code", "dt", label, "prob", *keep)))
    if not parts:
        raise ValueError("no fold has enough rows")
    return reduce(DataFrame.unionByName, parts)


# ---- metrics of folds --------------------------------------------------------------------------


def direction_metrics(predictions: DataFrame, label: str, prob: str, rule: str, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Per fold: rows, accuracy at 0.5, AUC, accuracy of the rule forecaster, and how far the model beats it."""
    by = list(by)
    hit = lambda x: F.avg(one_if(x == F.col(label)))
    known = predictions.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    d = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_val"), hit(one_if(F.col(prob) >= 0.5)).alias("accuracy"), hit(F.col(rule)).alias("rule_accuracy"))
    return d.join(auc(known, prob, label, by).select(*by, "auc"), by).withColumn("beat", F.col("accuracy") - F.col("rule_accuracy"))


def class_metrics(predictions: DataFrame, probs: Mapping[int, str], label: str, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Per fold: rows, accuracy of the likeliest class (the lowest of equal ones), one-vs-rest AUC of each class, and their mean.
    All classes are ranked in one stacked tie table. A class that is absent, or alone, has no AUC and is left out of the mean."""
    by = list(by)
    known = predictions.where(F.col(label).isNotNull() & reduce(Column.__and__, [F.col(p).isNotNull() for p in probs.values()]))
    best = F.greatest(*[F.col(p) for p in probs.values()]) if len(probs) > 1 else F.col(next(iter(probs.values())))
    guess = tiers([(F.col(p) == best, k) for k, p in probs.items()], None)
    hits = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_val"), F.avg(one_if(guess == F.col(label))).alias("accuracy"))
    stacked = known.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(p).cast("double").alias("p"), one_if(F.col(label) == k).alias("y")) for k, p in probs.items()])).alias("_s"))
    areas = auc(stacked.select(*by, "_s.k", "_s.p", "_s.y"), "p", "y", [*by, "k"]).where("n_pos > 0 and n_neg > 0")
    wide = areas.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("auc"))).alias(f"auc_{k}") for k in probs], F.avg("auc").alias("auc"))
    return hits.join(wide, by, "left")


def median_spread(predictions: DataFrame, pred: str, actual: str, by: Sequence[str] = ("fold",), n: int = 20) -> DataFrame:
    """Median outcome of each fold's n highest predictions, of its n lowest, and the difference (0 with fewer rows). Of equal
    predictions the earlier date, then the smaller code is taken."""
    by = list(by)
    known = predictions.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    size = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    medians = []
    for name, order in (("top", F.desc(pred)), ("bottom", F.asc(pred))):
        ends = known.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order, "dt", "code"))).where(F.col("_k") <= n)
        medians.append(ends.groupBy(*by).agg(F.percentile(actual, F.lit(0.5)).alias(f"{name}_median")))
    d = size.join(medians[0], by).join(medians[1], by)
    d = d.withColumns({c: F.when(F.col("n_rows") >= n, F.col(c)).otherwise(0.0) for c in ("top_median", "bottom_median")})
    return d.withColumn("spread", F.col("top_median") - F.col("bottom_median"))


# ---- rule forecasters --------------------------------------------------------------------------

#: Regimes in which the rule expects the market to rise (fixed values).
RISING = ("bull", "early_bull", "rebound", "range_up")


def market_rule(regimes: DataFrame) -> DataFrame:
    """1 on dates whose regime expects a rise, else 0 (unknown regimes too)."""
    return regimes.select("dt", one_if(F.col("regime_v2").isin(*RISING)).alias("rule_up"))


def sector_rule(features: DataFrame, rsi: str = "rsi_14", mom: str = "mom20", atr: str = "atr_pct") -> DataFrame:
    """Rule score of each industry and date, its third on the date (0 lowest), and whether the rule expects it to outperform.

    The score is the mean of what is known of: RSI over 100, momentum between its extremes, and one minus volatility
    between its extremes (an extent under one counts as one). Thirds are of first ranks, of equal scores the smaller code
    comes first; dates with two or fewer different scores have the middle third, as have rows without a score."""
    lows = features.agg(*[f(c).alias(f"{k}_{c}") for c in (mom, atr) for k, f in (("lo", F.min), ("hi", F.max))])
    end = lambda k, c: lows.select(f"{k}_{c}").scalar()
    scaled = lambda c: (F.col(c) - end("lo", c)) / F.greatest(F.lit(1.0), end("hi", c) - end("lo", c))
    parts = [F.col(rsi) / 100, scaled(mom), 1 - scaled(atr)]
    d = features.select("code", "dt", *[p.alias(f"_p{i}") for i, p in enumerate(parts)])
    total = sum((nz(f"_p{i}") for i in range(len(parts))), F.lit(0.0))
    known = sum((one_if(F.col(f"_p{i}").isNotNull()) for i in range(len(parts))), F.lit(0))
    d = d.select("code", "dt", F.round(F.when(known > 0, total / known), 9).alias("rule_score"))
    k = F.row_number().over(Window.partitionBy("dt").orderBy(F.asc_nulls_last("rule_score"), "code")) - 1  # an industry a row
    stats = d.groupBy("dt").agg((F.count("rule_score") - 1).alias("_n"), F.countDistinct("rule_score").alias("_d"))
    third = tiers([((F.col("_d") <= 2) | F.col("rule_score").isNull(), 1), (F.col("_k") * 3 <= F.col("_n"), 0), (F.col("_k") * 3 <= F.col("_n") * 2, 1)], 2)
    d = d.withColumn("_k", k).join(stats, "dt").withColumn("rule_tercile", third)
    return d.select("code", "dt", "rule_score", "rule_tercile", one_if(F.col("rule_tercile") >= 2).alias("rule_outperform"))

"""A feature store that is carried forward: a refresh reads the new bars and a small state, not the history.

The state of a code is what its next row needs: its last bars by count (for windows of any number of own bars,
however thinly it trades), and beside the newest of them the smoothed values, the running sums and the lengths of open runs. Building a
store in one refresh or in many gives the same features. A refresh is a numbered batch; it counts once
its state is written, so one that failed is repeated over what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ewm import span_rate, with_ewm_stages
from ..functions.scalar import div0, nz
from ..functions.windows import lag, mean_n, momentum
from ..session import discard, materialised


@dataclass(frozen=True)
class Recipe:
    """How a row's features follow from the bars so far.

    ``windows`` adds columns that look back over at most ``depth`` own bars and keeps all columns it gets. ``smoothed``
    are stages of ``out: (input, rate)``, whose inputs may use windows and earlier stages. ``totals`` are running sums of an
    expression (NULL adds nothing), ``runs`` counts of consecutive rows up to this one on which a condition
    holds (NULL: it does not). ``finish`` gives the stored columns of all of these.
    """

    depth: int
    windows: Callable[[DataFrame], DataFrame]
    smoothed: Sequence[Mapping[str, tuple[Column, float]]] = ()
    totals: Mapping[str, Column] = field(default_factory=dict)
    runs: Mapping[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], Sequence[Column | str]] = lambda d: [c for c in d.columns if not c.startswith("_")]

    @property
    def carried(self) -> list[str]:
        return [*(out for stage in self.smoothed for out in stage), *self.totals, *self.runs]


def _last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of every code; the state stands on the newest one."""
    newest = Window.partitionBy("code").orderBy(F.desc("dt"))
    d = df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    return d.withColumn("_state", F.when(F.col("_k") == 1, F.col("_state"))).drop("_k")


def fresh_rows(bars: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Bars after their code's last stored one. Earlier ones are left out: what a
    late bar changes reaches into all later rows, so its code is built anew."""
    bars = bars.where("code is not null and dt is not null")
    if carry is None:
        return bars
    last = carry.select("code", F.col("dt").alias("_last"))
    return bars.join(last, "code", "left").where("_last is null or dt > _last").drop("_last")


def advance(recipe: Recipe, bars: DataFrame, tail: DataFrame | None, carry: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features of the new bars, next tail, next carry); all three read one table in the shared folder, which the
    caller discards. New bars and tail are shuffled once, by code; ``bars`` is read twice if there is a tail."""
    carried, bar_columns = recipe.carried, bars.columns
    state = F.struct(*[F.col(c).cast("double").alias(c) for c in carried])
    none = F.lit(None).cast("struct<" + ",".join(f"`{c}`:double" for c in carried) + ">")
    both = fresh_rows(bars, carry).withColumns({"_new": F.lit(True), "_state": none})
    if tail is not None:
        if "_state" not in tail.columns:  # of a store whose tail had no state
            tail = tail.join(carry.select("code", "dt", state.alias("_state")), ["code", "dt"], "left")
        active = fresh_rows(bars.select("code", "dt"), carry).select("code").distinct()
        both = both.unionByName(tail.join(active, "code", "left_semi").withColumn("_new", F.lit(False)))
    d = recipe.windows(both.repartition("code").dropDuplicates(["code", "dt"]))
    # The newest stored bar of a code goes in front of its new rows with its state: the first value of a recursion.
    order = Window.partitionBy("code").orderBy("dt")
    d = d.withColumn("_seed", ~F.col("_new") & F.coalesce(F.lead("_new").over(order), F.lit(False)))
    d = d.where("_new or _seed").drop("_new")
    d = with_ewm_stages(d, [{out: (F.when(F.col("_seed"), F.col(f"_state.{out}")).otherwise(x), rate) for out, (x, rate) in stage.items()} for stage in recipe.smoothed])
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_i", F.sum(F.when(F.col("_seed"), 0).otherwise(1)).over(run))
    sums = {c: F.sum(F.coalesce(F.when(F.col("_seed"), F.col(f"_state.{c}")).otherwise(x.cast("double")), F.lit(0.0))).over(run) for c, x in recipe.totals.items()}
    lengths = {}
    for c, holds in recipe.runs.items():
        broken = F.max(F.when(~F.col("_seed") & ~F.coalesce(holds, F.lit(False)), F.col("_i"))).over(run)
        before = F.first(F.col(f"_state.{c}")).over(run)  # NULL unless the code's first row here is its state
        lengths[c] = (F.col("_i") - F.coalesce(broken, -before, F.lit(0))).cast("double")
    newest = F.lead("dt").over(order).isNull()
    d = d.withColumns(sums | lengths | {"_newest": newest}).where("not _seed")
    # the state is kept of the newest rows only
    rows = materialised(d.select(*recipe.finish(d), F.struct(*bar_columns).alias("_bar"), F.when(F.col("_newest"), state).alias("_state")))
    features = rows.drop("_bar", "_state")
    features._source = rows
    done, ends = rows.select("_bar.*", "_state"), rows.where("_state is not null").select("_bar.code", "_bar.dt", "_state.*")
    if carry is None:
        return features, _last_rows(done, recipe.depth), ends
    kept = carry.join(ends.select("code"), "code", "left_anti").select("code", "dt", *carried)
    return features, _last_rows(tail.select(*bar_columns, "_state").unionByName(done), recipe.depth), ends.unionByName(kept)


# ---- the store on disk -------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batches whose state is still there, in order."""
    fs, where = _folder(spark, f"{path}/state")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [n for n in found if fs.exists(_folder(spark, f"{path}/state/batch={n}/carry/_SUCCESS")[1])]


def refresh(spark: SparkSession, path: str, recipe: Recipe, bars: DataFrame) -> int:
    """Append the features of bars the store does not have yet and carry its state forward; returns
    the number of the newest batch. Bars without news change nothing. What is read and
    written grows with the new bars and the number of codes, not with the history."""
    done = batches(spark, path)
    now = done[-1] if done else 0
    tail = carry = None
    if done:
        tail, carry = (spark.read.parquet(f"{path}/state/batch={now}/{part}") for part in ("tail", "carry"))
    features, tail, carry = advance(recipe, bars, tail, carry)
    if not features.isEmpty():
        dated = features.withColumn("year", F.year("dt"))
        dated.write.mode("overwrite").partitionBy("year").parquet(f"{path}/features/batch={now + 1}")
        for name, df in (("tail", tail), ("carry", carry)):  # the carry is last: with it the batch counts
            df.write.mode("overwrite").parquet(f"{path}/state/batch={now + 1}/{name}")
        for old in done[:-1]:
            fs, where = _folder(spark, f"{path}/state/batch={old}")
            fs.delete(where, True)
        now += 1
    discard(features._source)
    return now


def stored_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of all finished batches; filters on ``year`` reach the files."""
    done = batches(spark, path)
    if not done:
        raise ValueError(f"no finished batch in {path}")
    return spark.read.parquet(f"{path}/features").where(F.col("batch") <= done[-1]).drop("batch")


# ---- recipes -----------------------------------------------------------------------------------


def trend_recipe() -> Recipe:
    """Long average, volume ratio, MACD, expanding autocorrelation and variance ratio, and whole run lengths."""

    def windows(bars: DataFrame) -> DataFrame:
        d = bars.select("*", mean_n("close", 250).alias("ma250"), (F.col("vol") / mean_n("vol", 20)).alias("vol_ratio"), momentum(1).alias("r"))
        return d.select("*", lag("r").alias("r_before"))

    close, r, before = (F.col(c) for c in ("close", "r", "r_before"))
    pair = lambda x: F.when(r.isNotNull() & before.isNotNull(), x)
    one = F.lit(1.0)

    def finish(_: DataFrame) -> list[Column | str]:
        n, x, y, xx, yy, xy = (F.col(f"sum_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
        spread = (xx - x * x / n) * (yy - y * y / n)
        correlation = F.when((n > 1) & (spread > 0), (xy - x * y / n) / F.sqrt(spread))
        return [
            "code", "dt", "close", "ma250", "vol_ratio",
            (F.col("ema12") - F.col("ema26")).alias("macd_dif"), F.col("dea").alias("macd_signal"), (F.col("ema12") - F.col("ema26") - F.col("dea")).alias("macd_hist"),
            F.when(F.col("n_returns") >= 30, nz(correlation)).alias("autocorr_1d"), div0(F.col("n_up"), F.col("n_returns")).alias("up_share"),
            F.col("up_run").cast("long").alias("up_run"), F.col("down_run").cast("long").alias("down_run"), F.col("n_bars").cast("long").alias("n_bars"),
        ]

    return Recipe(
        depth=250,
        windows=windows,
        smoothed=[
            {"ema12": (close, span_rate(12)), "ema26": (close, span_rate(26))},
            {"dea": (F.col("ema12") - F.col("ema26"), span_rate(9))},
        ],
        totals={
            "n_bars": one, "n_returns": F.when(r.isNotNull(), one), "n_up": F.when(r > 0, one), "sum_n": pair(one), "sum_x": pair(r), "sum_y": pair(before),
            "sum_xx": pair(r * r), "sum_yy": pair(before * before), "sum_xy": pair(r * before),
        },
        runs={"up_run": r > 0, "down_run": r < 0},
        finish=finish,
    )

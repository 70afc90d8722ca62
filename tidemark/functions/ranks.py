"""Exact cross-sectional ranks and percentiles that do not put a group into one task.

A date, an industry or the whole table may hold a third of all rows, so a plain
``rank() over (partition by dt order by x)`` would sort that third in a single task.
Here equal values are first counted together (map-side combine), each group is cut at
splitters of its own values, ranks are taken between two splitters, and a small table of
bucket totals supplies the offset. The result is the exact rank, wherever the values lie.
`with_pct_ranks` does so for large groups only; rows of all others are ranked in the task of their group.

Splitters are the values whose hash is a multiple of ``per_bucket``. Which these are depends on
the values alone, so a scan that is repeated, or a task that is, cuts at the same places. Buckets
have ``per_bucket`` values on average, and groups well below that are one bucket. The splitters
of a group are one array, about 8 bytes for every ``per_bucket`` values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .scalar import c, nan_to_null

PER_BUCKET = 1 << 16
#: Several ranks of a group of at most so many rows are taken in one task.
GROUP_ROWS = 1 << 19


def with_bucket(df: DataFrame, by: Sequence[str], order: Sequence[Column], per_bucket: int | None = None) -> DataFrame:
    """``_b``: how many splitters of the row's group are not above the row's place in ``order`` (ascending,
    NULLs first). Further columns in ``order`` part rows that are equal in the first."""
    by, key = list(by), order[0] if len(order) == 1 else F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    chosen = df.select(*by, key.alias("_v")).where(F.col("_v").isNotNull() & (F.pmod(F.xxhash64("_v"), F.lit(per_bucket or PER_BUCKET)) == 0))
    sample = chosen.groupBy(*by).agg(F.sort_array(F.collect_set("_v")).alias("_all"))
    step = F.ceil(F.sqrt(F.greatest(F.size("_all"), F.lit(1)))).cast("int")
    # every step-th splitter is looked at first, then the step splitters after the last one not above
    sample = sample.select(*by, F.struct(
        "_all", step.alias("step"), F.filter("_all", lambda _, i: i % step == 0).alias("coarse")
    ).alias("_s"))
    # groups without a splitter have no row in the sample
    joined = df.join(F.broadcast(sample), by, "left") if by else df.withColumn("_s", sample.scalar())
    joined = joined.withColumn("_c", F.size(F.filter("_s.coarse", lambda v: v <= key)))
    start = (F.col("_c") - 1) * F.col("_s.step")
    inside = F.filter(F.slice("_s._all", start + 1, F.col("_s.step")), lambda v: v <= key)
    # never NULL, or joins on it filter the rows below, once a reader, and the readers' exchanges differ
    bucket = F.coalesce(F.when(F.col("_c") > 0, start + F.size(inside)), F.lit(0))
    return joined.withColumn("_b", bucket).drop("_s", "_c")


def _offsets(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows below each bucket and group size; one row per (group, bucket)."""
    per_bucket = counted.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*by)
    return per_bucket.select(
        *by,
        "_b",
        (F.sum("_bn").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(w).alias("n_group"),
    )


def tie_table(df: DataFrame, by: Sequence[str], x, per_bucket: int | None = None) -> DataFrame:
    """One row per (group, distinct value): ``x, n_tie, n_below, n_group``; NULLs and NaNs ignored."""
    by = list(by)
    freq = (
        df.select(*by, c(x).cast("double").alias("x"))
        .where("x is not null and not isnan(x)")
        .groupBy(*by, "x")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    freq = with_bucket(freq, by, [F.col("x")], per_bucket)
    w = Window.partitionBy(*by, "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    local = freq.withColumn("_below", F.sum("_n").over(w) - F.col("_n"))
    return local.join(_offsets(freq, by), [*by, "_b"]).select(
        *by,
        "x",
        F.col("_n").alias("n_tie"),
        (F.col("_below") + F.col("_off")).alias("n_below"),
        "n_group",
    )


def average_rank() -> Column:
    """Average rank (1-based) of a tie_table row."""
    return F.col("n_below") + (F.col("n_tie") + 1) / 2


def with_rank_columns(df: DataFrame, by: Sequence[str], x: str, **outputs: Column) -> DataFrame:
    """Join expressions over the tie table back to every row of ``df`` (NULL x gets NULL)."""
    by = list(by)
    ranks = tie_table(df, by, x).select(
        *[F.col(b).alias(f"_k_{b}") for b in by],
        F.col("x").alias("_x"),
        *[e.alias(f"_o_{name}") for name, e in outputs.items()],
    )
    cond = F.col(x).cast("double") == F.col("_x")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"_k_{b}"))
    kept = df.columns
    return df.join(ranks, cond, "left").select(
        *[k for k in kept if k not in outputs], *[F.col(f"_o_{n}").alias(n) for n in outputs]
    )


def with_pct_rank(df: DataFrame, by: Sequence[str], x: str, out: str, scale: float = 100.0) -> DataFrame:
    """Average-tie rank divided by the group's row count, times ``scale``."""
    return with_rank_columns(df, by, x, **{out: average_rank() / F.col("n_group") * scale})


def with_pct_ranks(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Mapping[str, str], scale: float = 100.0,
    constant: float | None = None, group_rows: int | None = None,
) -> DataFrame:
    """Several percent ranks at once; ``keys`` name a row, and ``constant`` is the value given where all members of a
    group are equal. Rows of groups of at most ``group_rows`` rows (``GROUP_ROWS``) move once, by group, and are ranked where
    they lie; only larger groups are stacked and cut at splitters. Groups are counted first, from ``df``.
    """
    by, keys = list(by), list(keys)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (group_rows or GROUP_ROWS))
    large = materialised(sizes.select(*by))
    kept = [*keys, *[k for k in df.columns if k not in (*keys, *columns)], *columns]
    if large.isEmpty():
        return _ranked_whole(df, by, columns, scale, constant).select(*kept)
    whole, cut = df.join(F.broadcast(large), by, "left_anti"), df.join(F.broadcast(large), by, "left_semi")
    return _ranked_whole(whole, by, columns, scale, constant).select(*kept).unionByName(
        _ranked_stacked(cut, by, keys, columns, scale, constant).select(*kept)
    )


def _ranked_whole(df: DataFrame, by: list[str], columns: Mapping[str, str], scale: float, constant: float | None) -> DataFrame:
    """One exchange by group, then a sort a ranked column."""
    group = Window.partitionBy(*by)
    x = {s: f"_x_{s}" for s in dict.fromkeys(columns.values())}
    d = df.withColumns({v: nan_to_null(s) + 0.0 for s, v in x.items()})
    d = d.withColumns({f"_n_{s}": F.count(v).over(group) for s, v in x.items()})
    for s, v in x.items():
        # the place after the last equal value, and before the first one; NULLs have none
        w = group.orderBy(F.col(v).asc_nulls_last())
        d = d.withColumns({f"_to_{s}": F.count(v).over(w.rangeBetween(Window.unboundedPreceding, 0)), f"_at_{s}": F.rank().over(w) - 1})
    known = reduce(Column.__and__, [F.col(b).isNotNull() for b in by], F.lit(True))
    out = {}
    for o, s in columns.items():
        tie, n = F.col(f"_to_{s}") - F.col(f"_at_{s}"), F.col(f"_n_{s}")
        value = (F.col(f"_at_{s}") + (tie + 1) / 2) / F.nullif(n, F.lit(0)) * scale
        if constant is not None:
            value = F.when(tie == n, F.lit(float(constant))).otherwise(value)
        out[o] = F.when(known & F.col(x[s]).isNotNull(), value)
    return d.withColumns(out)


def _ranked_stacked(
    df: DataFrame, by: list[str], keys: list[str], columns: Mapping[str, str], scale: float, constant: float | None
) -> DataFrame:
    """The columns are stacked so all share one set of shuffles."""
    stacked = df.select(
        *dict.fromkeys(by + keys),
        F.explode(
            F.array(*[F.struct(F.lit(o).alias("f"), F.col(s).cast("double").alias("x")) for o, s in columns.items()])
        ).alias("_s"),
    ).select(*dict.fromkeys(by + keys), F.col("_s.f").alias("f"), F.col("_s.x").alias("x"))
    ranks = tie_table(stacked, [*by, "f"], "x")
    value = average_rank() / F.col("n_group") * scale
    if constant is not None:
        value = F.when(F.col("n_tie") == F.col("n_group"), F.lit(float(constant))).otherwise(value)
    ranked = stacked.join(ranks.select(*by, "f", "x", value.alias("r")), [*by, "f", "x"])
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("f") == o, F.col("r"))).alias(o) for o in columns])
    return df.drop(*columns).join(wide, keys, "left")


def exact_percentiles(df: DataFrame, by: Sequence[str], x, quantiles: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group, from the tie table (no per-group value list)."""
    by = list(by)
    t = tie_table(df, by, x)
    last = (F.col("n_group") - 1).cast("double")

    def at(pos: Column) -> Column:
        hit = (F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n_tie"))
        return F.max(F.when(hit, F.col("x")))

    aggs, outs = [], []
    for name, q in quantiles.items():
        h = last * F.lit(float(q))
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
        aggs += [F.max(h - F.floor(h)).alias(f"_f_{name}")]
        lo, hi, f = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        outs.append((lo + (hi - lo) * f).alias(name))
    return t.groupBy(*by).agg(*aggs).select(*by, *outs) if by else t.agg(*aggs).select(*outs)


def with_place(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, total: str | None = None, per_bucket: int | None = None
) -> DataFrame:
    """Unique 1-based place of every row in its group, in ascending ``order`` (NULLs first), and the rows of the
    group as ``total``. Rows that tie in the first column are parted by the next ones, so no value is one task."""
    by = list(by)
    bucketed = with_bucket(df, by, order, per_bucket)
    counted = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by, "_b").orderBy(*[o.asc_nulls_first() for o in order])
    placed = bucketed.withColumn("_rn", F.row_number().over(w)).join(_offsets(counted, by), [*by, "_b"])
    placed = placed.withColumn(out, F.col("_rn") + F.col("_off"))
    placed = placed.withColumn(total, F.col("n_group")) if total else placed
    return placed.select(*[k for k in df.columns if k not in (out, total)], out, *([total] if total else []))


def with_position(df: DataFrame, x: str, tie: str, out: str = "pos", per_bucket: int | None = None) -> DataFrame:
    """Unique 1-based position of every row in the order (x, tie), over the whole table."""
    return with_place(df, [], [F.col(x), F.col(tie)], out, per_bucket=per_bucket)


def with_group_stats(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per group joined back to the rows: partial aggregation instead of a
    whole-group window; the planner broadcasts the small side only when its size allows."""
    by = list(by)
    return df.join(df.groupBy(*by).agg(*aggs), by, "left")

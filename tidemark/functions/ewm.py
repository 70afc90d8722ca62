"""Exponential smoothing (``adjust=False``) as window sums, without Python workers.

y_t = (1-a) y_{t-1} + a x_t over the values of a key that are not NULL; a NULL row takes the
value before it and costs no decay. The recursion has the closed form
y_t = (1-a)^j * sum_i w_i x_i (1-a)^-i inside a block of values, plus the block's
incoming value times (1-a)^(j+1). Block lengths follow from the rate: short enough to keep the
powers inside the double range, long enough that what is carried over two borders
weighs less than double precision.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# (1-a)^-length may reach e^MOST and must reach e^LEAST.
LEAST, MOST = 40.0, 650.0


def span_rate(span: int) -> float:
    return 2.0 / (span + 1)


def wilder_rate(n: int) -> float:
    return 1.0 / n


def block_lengths(rates: Mapping[str, float]) -> dict[str, int]:
    """A block length per output: one for all if the rates allow it, so that they share a sort."""
    decay = {k: -log(1.0 - a) for k, a in rates.items() if a < 1}
    if decay:
        common = floor(MOST / max(decay.values()))
        if common * min(decay.values()) >= LEAST:
            decay = dict.fromkeys(decay, MOST / common if common else MOST)
    return {k: ceil(MOST / decay[k] - 1e-9) if k in decay else 1 for k in rates}


def with_ewm(
    df: DataFrame, specs: Mapping[str, tuple[str, float]], key: str = "code", order: str = "dt", together: bool = False
) -> DataFrame:
    """Add one smoothed column per ``out: (input, rate)``, 0 < rate <= 1; the first value that is
    not NULL seeds the recursion, rows before it are NULL. ``together``: the inputs are NULL on the same rows,
    so that they share their blocks and a sort."""
    return with_ewm_stages(df, [specs], key, order, together)


def with_ewm_stages(
    df: DataFrame, stages: Sequence[Mapping[str, tuple[Column | str, float]]], key: str = "code", order: str = "dt", together: bool = False
) -> DataFrame:
    """``with_ewm`` in stages: inputs are columns or expressions over ``df`` and the outputs of earlier stages.

    A stage whose inputs share their blocks leaves its rows sorted by block and ``order``, which is the order of ``order``,
    and the next one goes on from there: one sort a stage and one before."""
    made = {out for stage in stages for out in stage}
    d, orders, outputs = df, [order], [k for k in df.columns if k not in made]
    for i, stage in enumerate(stages):
        for out, (_, a) in stage.items():
            if not 0 < a <= 1:
                raise ValueError(f"smoothing rate of {out} outside (0, 1]: {a}")
        derived = {out: f"_in{i}_{out}" for out, (x, _) in stage.items() if not isinstance(x, str)}
        d = d.select("*", *[stage[out][0].alias(name) for out, name in derived.items()])
        d, orders = _smoothed(d, {out: (derived.get(out, x), a) for out, (x, a) in stage.items()}, key, orders, together)
    return d.select(*outputs, *[out for stage in stages for out in stage])


def _smoothed(
    df: DataFrame, specs: Mapping[str, tuple[str, float]], key: str, orders: list[str], together: bool
) -> tuple[DataFrame, list[str]]:
    """The outputs of one stage, and the columns its rows are sorted by."""
    kept = [k for k in df.columns if k not in specs]
    lengths = block_lengths({out: a for out, (_, a) in specs.items()})
    inputs = list(dict.fromkeys(x for x, _ in specs.values()))
    counted = {x: inputs[0] if together else x for x in inputs}
    w = Window.partitionBy(key).orderBy(*orders)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.select("*", *[F.count(F.col(x)).over(run).alias(f"_c_{x}") for x in dict.fromkeys(counted.values())])
    places = dict.fromkeys((counted[x], lengths[out]) for out, (x, _) in specs.items())
    d = d.select("*", *[F.floor((F.col(f"_c_{x}") - 1) / n).alias(f"_b_{x}_{n}") for x, n in places])
    j_of = lambda x, n: F.col(f"_c_{x}") - 1 - F.col(f"_b_{x}_{n}") * n
    locals_ = []
    for out, (x, a) in specs.items():
        k, n = counted[x], lengths[out]
        in_block = Window.partitionBy(key, f"_b_{k}_{n}").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
        j = j_of(k, n)
        weight = F.when(F.col(f"_c_{k}") == 1, F.lit(1.0)).otherwise(F.lit(a))
        term = F.when(F.col(x).isNotNull(), F.col(x) * weight * F.pow(F.lit(1.0 - a), -j)).otherwise(0.0)
        locals_.append((F.sum(term).over(in_block) * F.pow(F.lit(1.0 - a), j)).alias(f"_l_{out}"))
    d = d.select("*", *locals_)
    if len(places) == 1:  # blocks follow one another, so this is the same order and the rows are sorted by it
        block = f"_o{len(orders)}"
        (place,) = places
        d = d.withColumn(block, F.col("_b_%s_%d" % place))
        orders, kept = [block, *orders], [*kept, block]
        w = Window.partitionBy(key).orderBy(*orders)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    raws = []
    for out, (x, a) in specs.items():
        k, n = counted[x], lengths[out]
        j = j_of(k, n)
        block_end = F.last(F.when(j == n - 1, F.col(f"_l_{out}")), ignorenulls=True).over(past)
        carried = F.coalesce(block_end, F.lit(0.0)) * F.pow(F.lit(1.0 - a), j + 1)
        raws.append(F.when(F.col(x).isNotNull(), F.col(f"_l_{out}") + carried).alias(f"_y_{out}"))
    d = d.select(*kept, *raws)
    return d.select(*kept, *[F.last(f"_y_{out}", ignorenulls=True).over(run).alias(out) for out in specs]), orders


def with_ewm_adjusted(
    df: DataFrame, specs: Mapping[str, tuple[str, float]], key: str = "code", order: str = "dt"
) -> DataFrame:
    """Like ``with_ewm``, but weighted averages of the values so far (``adjust=True``): the weights (1-a)^age
    are divided by their sum, so the first value counts no more than its age allows.

    Numerator and denominator are both decayed sums. With y the smoothed value that is seeded by the first value x0, and
    n values so far, the average is (y - (1-a)^n x0) / (1 - (1-a)^n)."""
    raw = with_ewm(df, {f"_y_{out}": spec for out, spec in specs.items()}, key, order)
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, (x, a) in specs.items():
        rest = F.pow(F.lit(1.0 - a), F.count(F.col(x)).over(run))
        out[name] = (F.col(f"_y_{name}") - rest * F.first(F.col(x), ignorenulls=True).over(run)) / (F.lit(1.0) - rest)
    return raw.select(*[k for k in df.columns if k not in specs], *[v.alias(k) for k, v in out.items()])

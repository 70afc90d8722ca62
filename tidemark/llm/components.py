"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialised


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one type; null ends are dropped).

    Each round points every node to the neighbour (or itself) with the smallest hash and
    replaces nodes by their targets. The hash order is unrelated to the ids, so chains of
    consecutive ids shrink as fast as stars and the rounds grow with the logarithm of the
    largest component. Every round is a table in the shared folder; nothing but an emptiness
    flag reaches the driver. The root is some node of the component, the same for all of it.
    """
    edges = materialised(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    # The nodes of the input, each with its present target; composed round by round.
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = materialised(
            both.groupBy("a")
            .agg(F.min_by("b", F.xxhash64("b")).alias("m"), F.min(F.xxhash64("b")).alias("h"))
            .select(F.col("a").alias("node"), F.when(F.col("h") < F.xxhash64("a"), F.col("m")).otherwise(F.col("a")).alias("root"))
        )
        if labels is None:
            merged = step
        else:
            merged = materialised(
                labels.alias("l")
                .join(step.alias("s"), F.col("l.root") == F.col("s.node"), "left")
                .select("l.node", F.coalesce("s.root", "l.root").alias("root"))
            )
            discard(labels)
        to = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        tb = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialised(
            edges.join(to, "a").join(tb, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
        discard(edges)
        if labels is not None:
            discard(step)
        edges, labels = left, merged
        if edges.isEmpty():
            discard(edges)
            return labels

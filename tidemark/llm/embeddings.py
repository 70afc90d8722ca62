"""Near-duplicates among embeddings by NN-descent.

A neighbour graph is seeded by the leaves of random hyperplane trees and refined: at every vector
its neighbours (and those that have it as a neighbour) are compared with each other, and each
pair closer than what either end has is sent there. Wherever vectors are compared, the links among
them (cosine at or above the threshold) are kept as a spanning forest, however full the lists are.
The next round looks for neighbours outside the connected groups found so far, so links inside
a group fill no list. An audit against all rows decides if another round is needed; if rounds
do not do, all blocks are compared. Links are counted inside the connected groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialised
from .components import components

NEIGHBOURS = 10
LEAF = 256  # about as many vectors share a leaf
TREES = 12
BLOCK = 512  # vectors in a block of a group's comparison
SPLIT = 16  # further hyperplanes for leaves that are too large
AUDIT = 512  # vectors of each kind of group compared with all rows in the audit
ALONE = 4096  # the same of vectors without a link
MARGIN = 1e-6  # of cosines in float precision
RECALL = 0.99
ROUNDS = 4


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of every row: the vector in double precision scaled to length 1, or null if it
    is null, empty, zero, or holds a null or non-finite component, or if the id is null."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    # Scaled by the largest component first, lest squares overflow or vanish.
    rows = vectors.select("vec_id", v.alias("v")).withColumn("m", F.array_max(F.transform("v", lambda x: F.abs(x))))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.col("m") > 0) & (F.col("m") < float("inf")) & F.col("vec_id").isNotNull()
    scaled = rows.select("vec_id", F.when(fine, F.transform("v", lambda x: x / F.col("m"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("n", norm).select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _forest(ids: np.ndarray, s: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the rows of a block as all its links do, among those ``apart``; pairs that
    rounding could make a link are all returned, to be verified."""
    linked = apart & (s >= threshold + MARGIN)
    i, j = np.nonzero(np.triu(apart & (np.abs(s - threshold) < MARGIN), 1))
    found, left = [], linked.any(axis=1)
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            found.append((np.full(len(new), x), new))
            queue.extend(new)
    x, y = (np.concatenate([c, *(f[k] for f in found)]).astype(np.int64) for k, c in enumerate((i, j)))
    return ids[x], ids[y]


def _edges(lists: tuple, ties: tuple) -> pa.Table:
    """Rows of neighbour lists, and links (tie) that may be in no list."""
    a, b, sim = (np.asarray(x) for x in lists)
    return pa.table({
        "a": np.concatenate([a, ties[0]]), "b": np.concatenate([b, ties[1]]), "sim": np.concatenate([sim, np.ones(len(ties[0]))]),
        "tie": np.repeat([False, True], [len(a), len(ties[0])]),
    })


EDGES = "a long, b long, sim double, tie boolean"


def seeds(points: DataFrame, width: int, count: int, first: int, k: int, threshold: float, trees: int = TREES) -> DataFrame:
    """Edges (a, b, sim, tie) in the leaves of each tree: to the k nearest vectors of other roots, and
    ties that connect what is linked.

    A leaf is the signs of random projections, as many as make leaves of about LEAF vectors. A
    larger one is split by further projections; what those do not part (a large group of
    nearly equal vectors) is dealt into parts of about that many."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / LEAF)))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("v"))
            for t in range(first, first + trees):
                signs = x @ np.random.default_rng((7, t)).standard_normal((width, bits + SPLIT)) > 0
                code, more = signs[:, :bits] @ (1 << np.arange(bits)), signs[:, bits:] @ (1 << np.arange(SPLIT))
                columns = [b.column("id"), b.column("root"), b.column("v"), pa.array(np.full(len(x), t), pa.int32()), pa.array(code.astype(np.int64)), pa.array(more)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "v", "t", "leaf", "more"])

    def inside(key, rows):
        ids, root, x = rows.column("id").to_numpy(), rows.column("root").to_numpy(), _vectors(rows.column("v"))
        s, apart = x @ x.T, root[:, None] != root[None, :]
        ties = _forest(ids, s, apart, threshold)
        n = min(k, len(ids) - 1)
        if n < 1:
            return _edges((ids[:0], ids[:0], np.zeros(0)), ties)
        s[~apart] = -2
        to = np.argpartition(-s, n - 1, axis=1)[:, :n]
        sim = np.take_along_axis(s, to, axis=1)
        i, j = np.nonzero(sim > -2)
        return _edges((ids[i], ids[to[i, j]], sim[i, j]), ties)

    coded = points.select("id", "root", "v").mapInArrow(leaf, "id long, root long, v array<double>, t int, leaf long, more long")
    codes = coded.select("t", "leaf", "more").groupBy("t", "leaf", "more").count()
    further = F.least(F.lit(SPLIT), F.greatest(F.lit(0), F.ceil(F.log2(F.sum("count") / (4 * LEAF))))).cast("int")
    splits = codes.groupBy("t", "leaf").agg(further.alias("e"))
    split = F.col("more").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("e")) - 1)
    sizes = codes.join(splits, ["t", "leaf"]).withColumn("split", split).groupBy("t", "leaf", "e", "split").agg(F.ceil(F.sum("count") / (4 * LEAF)).alias("parts"))
    dealt = coded.join(splits, ["t", "leaf"]).withColumn("split", split).join(sizes.drop("e"), ["t", "leaf", "split"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")))
    return dealt.groupBy("t", "leaf", "split", "part").applyInArrow(inside, EDGES)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector: a, b, sim, new (not in an earlier list)."""
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    # Ranks up to k are kept on the map side too, so no list is longer anywhere.
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.desc("b")))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "sim", "new")


def descend(points: DataFrame, graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: compare the neighbours of every vector with each other; return the pairs of different
    roots, in both directions, that are nearer than the farthest in the list of their first end,
    and ties that connect what is linked.

    A vector takes part with its own list and at most k of the vectors that list it (chosen by
    hash), pairs of two old neighbours are skipped."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "new")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
    some = back.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "new")
    hood = graph.select("a", "b", "new").union(some).groupBy("a", "b").agg(F.max("new").alias("new"))
    least = graph.groupBy("a").agg(F.when(F.count("*") < k, F.lit(-2.0)).otherwise(F.min("sim")).alias("least"))
    # Float precision will do for ordering; links are verified in double precision afterwards.
    near = points.join(least.withColumnRenamed("a", "id"), "id", "left").select(
        F.col("id").alias("b"), "root", F.col("v").cast("array<float>").alias("v"), F.coalesce("least", F.lit(-2.0)).alias("least")
    )

    def meet(key, rows):
        ids, x = rows.column("b").to_numpy(), _vectors(rows.column("v")).astype(np.float64)
        new, floor = rows.column("new").to_numpy(), rows.column("least").to_numpy()
        s, root = x @ x.T, rows.column("root").to_numpy()
        apart = (new[:, None] | new[None, :]) & (root[:, None] != root[None, :])
        i, j = np.nonzero(apart & (s > floor[:, None]))
        return _edges((ids[i], ids[j], s[i, j]), _forest(ids, s, apart, threshold))

    return hood.join(near, "b").select("a", "b", "new", "root", "v", "least").groupBy("a").applyInArrow(meet, EDGES)


def verified(points: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a < b) whose cosine in double precision is at least ``threshold``."""
    near = edges.where(F.col("sim") >= threshold - 1e-4)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    va, vb = points.select(F.col("id").alias("a"), F.col("v").alias("va")), points.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(va, "a").join(vb, "b").where(dot >= threshold).select("a", "b")


def _block_pairs(member: DataFrame) -> DataFrame:
    """Rows (root, id, ...) dealt so that any two blocks of BLOCK vectors of a root meet: the block pair
    (x, y), x <= y, gets block x as one side and block y as the other; i is the row's block."""
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = member.join(sizes, "root").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    return placed.select("*", other).withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")})


def all_ties(points: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sim, tie) that connect all points as all links do, by comparing every block with every
    other: exact, and quadratic."""

    def compare(key, rows):
        ids, x = rows.column("id").to_numpy(), _vectors(rows.column("v"))
        return _edges((ids[:0], ids[:0], np.zeros(0)), _forest(ids, x @ x.T, ~np.eye(len(ids), dtype=bool), threshold))

    dealt = _block_pairs(points.select(F.lit(0).alias("root"), "id", "v"))
    return dealt.select("x", "y", "id", "v").groupBy("x", "y").applyInArrow(compare, EDGES)


def group_links(points: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for vectors of connected groups, the rows within the threshold, without itself.

    Every group is cut into blocks of BLOCK vectors and compared block by block in double
    precision; a task holds two blocks and returns counts, no pairs. The number of links is what
    is asked for and is quadratic in a group; no group is in one task."""
    member = of.select(F.col("node").alias("id"), "root").join(points, "id")
    dealt = _block_pairs(member.select("root", "id", "v", "copies"))

    def compare(key, rows):
        block, x, y = rows.column("i").to_numpy(), key[1].as_py(), key[2].as_py()
        ids, copies, v = rows.column("id").to_numpy(), rows.column("copies").to_numpy(), _vectors(rows.column("v"))
        p, q = block == x, block == y
        linked = v[p] @ v[q].T >= threshold
        if x == y:
            np.fill_diagonal(linked, True)  # a vector and its copies, whatever rounding does to 1
            return pa.table({"id": ids[p], "links": linked @ copies[q] - 1})
        return pa.table({"id": np.concatenate([ids[p], ids[q]]), "links": np.concatenate([linked @ copies[q], linked.T @ copies[p]])})

    counts = dealt.groupBy("root", "x", "y").applyInArrow(compare, "id long, links long")
    return counts.groupBy("id").agg(F.sum("links").alias("links"))


def audit(points: DataFrame, of: DataFrame, threshold: float) -> float:
    """Estimated mean over the distinct vectors that have a link of the share of their links that is
    inside their group; copies count for nothing. The lower of two means: over the vectors of large
    groups, and over all others, so that large groups make up for no missed pair.

    Asked are, by least hash of the id, ALONE vectors without a group and AUDIT each of small
    and large groups; each kind weighs what it has. They are bounded and compared with all rows."""
    size = of.groupBy("root").count()
    kinds = size.select("root", F.when(F.col("count") > NEIGHBOURS, 2).otherwise(1).alias("kind"))
    rooted = points.select("id", "v").join(of.join(kinds, "root").withColumnRenamed("node", "id"), "id", "left")
    rooted = materialised(rooted.select("id", "v", F.coalesce("root", "id").alias("root"), F.coalesce("kind", F.lit(0)).alias("kind")))
    many = {r.kind: r["count"] for r in rooted.groupBy("kind").count().collect()}
    asked = [r for kind in many for r in rooted.where(F.col("kind") == kind).orderBy(F.xxhash64("id"), "id").limit(AUDIT if kind else ALONE).collect()]
    if not asked:
        return 1.0
    ids, roots, q = np.array([r.id for r in asked]), np.array([r.root for r in asked]), np.array([r.v for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            x, own, root = _vectors(b.column("v")), b.column("id").to_numpy(), b.column("root").to_numpy()
            for i in range(0, len(ids) if len(x) else 0, AUDIT):
                part = slice(i, i + AUDIT)
                near = (q[part] @ x.T >= threshold) & (ids[part, None] != own[None, :])
                true[part] += near.sum(axis=1)
                found[part] += (near & (roots[part, None] == root[None, :])).sum(axis=1)
        has = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(true[has]), pa.array(found[has])], names=["id", "true", "found"])

    sums = rooted.mapInArrow(run, "id long, true long, found long").groupBy("id").agg(F.sum("true").alias("t"), F.sum("found").alias("f")).collect()
    discard(rooted)
    kind_of, drawn = {r.id: r.kind for r in asked}, {k: sum(r.kind == k for r in asked) for k in many}
    means = []
    for kinds in ({0, 1}, {2}):
        seen = [(many[kind_of[r.id]] / drawn[kind_of[r.id]], r.f / r.t) for r in sums if kind_of[r.id] in kinds]
        means += [sum(w * x for w, x in seen) / sum(w for w, _ in seen)] if seen else []
    return min(means, default=1.0)


def ties_of(points: DataFrame, width: int, count: int, first: int, k: int, threshold: float) -> DataFrame:
    """Links (a, b, sim) found by one seeding and two rounds, between vectors of different roots."""
    start = materialised(seeds(points, width, count, first, k, threshold))
    ties = start.where("tie")
    graph = materialised(best(start.where("not tie").drop("tie").withColumn("new", F.lit(True)), k))
    for _ in range(2):
        found = materialised(descend(points, graph, k, threshold))
        ties = ties.unionByName(found.where("tie"))
        listed = found.where("not tie").drop("tie").withColumn("new", F.lit(True))
        following = materialised(best(graph.withColumn("new", F.lit(False)).unionByName(listed), k))
        discard(graph)
        graph = following
    return ties.select("a", "b", "sim")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = NEIGHBOURS, recall: float = RECALL, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of cosine >= ``threshold`` in double precision. Vectors that are null, empty,
    zero, or hold a null or non-finite component link with nothing, nor do rows without an id;
    vectors of different lengths do not link with each other, and every length is compared on its
    own. A repeated vec_id is a row each, with the links of its own vector. n_links counts the
    other rows a row links with, its exact copies included; component_id is the smallest
    vec_id reachable. An empty table gives an empty result. If the audit still finds less than
    ``recall`` after ``rounds`` seedings, all blocks of vectors are compared, and the result is exact.

    Equal vectors are one point, so a group of exact copies costs no more than one vector.
    """
    rows = materialised(unit_rows(vectors))
    fine = rows.where("v is not null")
    points = fine.groupBy("v").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"))
    # The number of a point is fixed once the table is written.
    points = materialised(points.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    of = None
    for r in sorted(points.groupBy("width").count().collect()):
        one = points.where(F.col("width") == r.width).drop("width")
        part = linked_points(one, r.width, r["count"], threshold, k, recall, rounds)
        of = part if of is None else of.unionByName(part)
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    placed = alone if of is None else fine.join(of, "v").select("vec_id", "n_links", "component_id").unionByName(alone)
    return placed.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def linked_points(points: DataFrame, width: int, count: int, threshold: float, k: int, recall: float, rounds: int) -> DataFrame:
    """v, n_links, component_id of ``points`` (id, v, least: smallest vec_id, copies) of one length."""
    of, pairs = points.sparkSession.createDataFrame([], "node long, root long"), None
    for r in range(rounds + 1 if count > 1 else 0):
        if r < rounds:
            rooted = points.join(of.withColumnRenamed("node", "id"), "id", "left").select("id", "v", F.coalesce("root", "id").alias("root"))
            found = ties_of(materialised(rooted), width, count, r * TREES, k, threshold)
        else:
            found = all_ties(points, threshold)
        new = verified(points, found, threshold)
        pairs = materialised(new if pairs is None else pairs.unionByName(new))
        of = of if pairs.isEmpty() else components(pairs)
        if r < rounds and audit(points, of, threshold) >= recall:
            break
    inside = group_links(points, of, threshold).withColumnRenamed("links", "n")
    links = points.join(inside, "id", "left").select("id", F.coalesce("n", F.col("copies") - 1).alias("links"))
    each = points.join(of.withColumnRenamed("node", "id"), "id", "left").join(links, "id")
    each = each.select("v", "least", F.col("links").cast("long").alias("n_links"), F.coalesce("root", "id").alias("root"))
    first = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(first, "root").select("v", "n_links", "component_id")

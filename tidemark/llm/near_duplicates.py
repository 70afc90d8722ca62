"""SimHash near-duplicates by meet-in-the-middle ball hashing, and all pairs of texts whose
shingles have a Jaccard similarity of a threshold or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialised
from .common import fresh, small, text_key
from .components import components

SEED = 42
#: Bits of a text are counted in pieces of this many shingles, so one long text needs little memory.
PIECE = 1 << 16
#: One text in so many is looked at for frequent shingles; one in as many of these texts, at most so many.
SAMPLE, OFTEN, FREQUENT = 8, 8, 200_000
#: Longs in the sketch of a set (1,024 bits).
SKETCH = 16
#: Lists of nodes are broadcast up to this many rows (16 MB), beyond it joins shuffle.
BROADCAST_NODES = 500_000
#: Buckets of over LARGE nodes take turns of random neighbours while one of their rows is expected to meet
#: over PAIRS similar ones and a turn at least halves that; at most TURNS.
LARGE, PAIRS, TURNS = 32, 4, 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (signed 64-bit result)."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, ones, hashes = 0, np.zeros(64, np.int64), []
    for h in parts:
        hashes.append(xxhash.xxh64_intdigest(h, SEED))
        if len(hashes) == PIECE:
            total, ones, hashes = total + PIECE, ones + _bits(hashes), []
    total, ones = total + len(hashes), ones + _bits(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every document; no words (null, empty): 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def ball(fp: Column, radius: int) -> Column:
    """All values that differ from ``fp`` in at most ``radius`` bits (0 or 1)."""
    if radius == 0:
        return F.array(fp)
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, at most ``distance`` bits apart, that connect the
    same fingerprints as all such pairs do.

    Two fingerprints within 2r bits of each other share a value within r bits of both, so each
    emits its ball of radius r and those that meet on a value are linked. At most 65 different
    fingerprints have a value in common, so no bucket is large however many documents
    share a fingerprint. In a bucket neighbours in sorted order are linked, which
    connects it whole; every pair is verified. For odd distances one side of the pair uses the
    smaller radius; only 0, 2 are offered here.
    """
    if distance not in (0, 2):
        raise ValueError("distance must be 0 or 2: half of it is the radius of the balls")
    variants = fps.select("fp", F.explode(ball(F.col("fp"), distance // 2)).alias("v"))
    before = F.lag("fp").over(Window.partitionBy("v").orderBy("fp"))
    pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable by links).

    Reads doc_id and text. Documents without words have fingerprint 0 and are linked like any
    other; repeated rows are returned each. A null doc_id is its component's id only
    if there is no other. An empty table gives an empty result.
    """
    rows = materialised(fingerprints(docs, shingle))
    least = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(least.select("fp"), distance))
    root = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = root.join(first, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, shingle: int = 5, distance: int = 2) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one of the smallest
    doc_id. Of repeated rows with that id and text one stays. Documents without an id are kept."""
    of = near_duplicates(docs, shingle, distance).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(of, "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the shingles of a text; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set in an order that is the same for all sets (frequent ones last):
    so many that two sets of similarity ``threshold`` or more have one of them in common."""
    n = len(hashes) - int(np.ceil(threshold * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if not len(frequent):
        return hashes[:n]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    often = frequent[at] == hashes
    return np.concatenate([hashes[~often], hashes[often][np.argsort(rank[at[often]])]])[:n]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH longs: bit i is the parity of the number of hashes that fall on it."""
    at, many = np.unique(hashes & (64 * SKETCH - 1), return_counts=True)
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[at] = many & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def possible(na: Column, nb: Column, bits_a: Column, bits_b: Column, threshold: float) -> Column:
    """False only for pairs of sets that have less than that Jaccard similarity: sketches differ in no
    more bits than the sets do in elements."""
    differ = F.bit_count(F.get(bits_a, F.lit(0)).bitwiseXOR(F.get(bits_b, F.lit(0))))
    for i in range(1, SKETCH):
        differ = differ + F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i))))
    sizes = F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - 1e-6
    return sizes & (differ <= F.lit((1 - threshold) / (1 + threshold)) * (na + nb) + 1e-6)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of every row: its shingles, and 128 bits that stand for them."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node binary, hashes array<long>")


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many different texts, sorted, and their rank by frequency. They only shape the
    order of prefixes: any list gives the same links, this one small buckets."""
    some = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(SAMPLE)) == 0)
    each = _sets(some, shingle).dropDuplicates(["node"]).select(F.explode("hashes").alias("h"))
    top = each.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(FREQUENT)
    found = np.array([r.h for r in top.collect()], np.int64)
    order = np.argsort(found)
    return found[order], -order


def _similar(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact Jaccard similarity is at least ``threshold``."""
    asked = materialised(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
    sets = materialised(_sets(docs, shingle).join(small(asked, BROADCAST_NODES), "node", "left_semi").dropDuplicates(["node"]))
    one, two = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("i"), (F.size("ha") + F.size("hb")).alias("n"))
    out = materialised(both.where(F.col("i") >= F.lit(threshold) * (F.col("n") - F.col("i")) - 1e-9).select("a", "b"))
    discard(asked, sets)
    return out


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: neighbours of one fingerprint, and one node each of linked fingerprints."""
    same = nodes.select(F.lag("node").over(Window.partitionBy("fp").orderBy("n", "node")).alias("a"), F.col("node").alias("b")).where("a is not null")
    one = materialised(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    linked = links(one.select("fp")).toDF("fa", "fb")
    return same.union(linked.join(one.toDF("fa", "a"), "fa").join(one.toDF("fb", "b"), "fb").select("a", "b"))


def similar(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, k1, k2 (see text_key), node, root for every row: root is the same for texts connected by pairs
    of Jaccard similarity ``threshold`` or more, and no pair is missed. Texts without words are alike.

    Texts with the same shingles are one node. SimHash balls propose nodes up to two bits apart.
    That is few of the pairs near the threshold, so prefixes make it whole: two nodes of a pair
    share a shingle of their prefixes, and these are buckets. Neighbours by size in a bucket are
    proposed with what the balls propose, and every node is compared with the one that is
    proposed most often; then all pairs of buckets that are not yet connected. What the first
    step connects costs no pairs in the second; members of a bucket that it does not connect
    do. So while many are expected, neighbours of random orders are compared in between. Sizes, the shingle's places and the sketches of both sets rule pairs out before
    any set moves.
    """
    frequent, rank = _frequent(docs, shingle)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            first = pa.array([prefix(x, frequent, rank, threshold) for x in sets], pa.list_(pa.int64()))
            fps = [np.packbits(2 * _bits(x) > len(x), bitorder="little").view("<i8")[0] for x in sets]
            bits = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            columns = [*(b.column(c) for c in ("doc_id", "k1", "k2")), nodes, pa.array([len(x) for x in sets], pa.int32()), pa.array(fps, pa.int64()), first, bits]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "node", "n", "fp", "first", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    made = docs.select("doc_id", *text_key(text), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, node binary, n int, fp long, first array<long>, bits array<long>"
    )
    made = materialised(made)
    rows = materialised(made.select("doc_id", "k1", "k2", "node"))
    nodes = materialised(made.dropDuplicates(["node"]).select("node", "n", "fp", "bits"))
    each = made.dropDuplicates(["node"]).select("node", "n", F.posexplode("first").alias("p", "h"))
    order = Window.partitionBy("h").orderBy("n", "node")
    seen = each.withColumn("size", F.count("*").over(Window.partitionBy("h"))).withColumn("before", F.lag(F.struct("node", "n", "p")).over(order))
    buckets = materialised(seen.where(F.col("size") > 1))
    discard(made)
    least = lambda na, nb: F.lit(threshold) / (1 + F.lit(threshold)) * (na + nb) - 1e-6  # noqa: E731  words in common
    room = lambda na, pa_, nb, pb: F.least(na - pa_, nb - pb) + F.least(pa_, pb)
    chains = buckets.where("before is not null").select(F.col("before.node").alias("a"), F.col("before.n").alias("na"), F.col("before.p").alias("pa"), F.col("node").alias("b"), "n", "p")
    fits = (F.least("na", "n") >= least(F.col("na"), F.col("n"))) & (room(F.col("na"), F.col("pa"), F.col("n"), F.col("p")) >= least(F.col("na"), F.col("n")))
    proposed = chains.where(fits).select("a", "b").union(_balls(nodes)).groupBy("a", "b").count()
    one, two = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    able = possible(F.col("na"), F.col("nb"), F.col("ba"), F.col("bb"), threshold)
    proposed = proposed.join(one, "a").join(two, "b").where(able)
    tried = materialised(proposed.groupBy("b").agg(F.max(F.struct("count", "a")).alias("x")).select("x.a", "b"))
    links = _similar(docs, tried, shingle, threshold)
    of = components(links)
    # What these leave: pairs of buckets that are in different components. Groups of many different texts
    # are connected by neighbours in random orders first, or nearly all their pairs would be left.
    need = least(F.col("na"), F.col("nb"))
    fits = (F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= need) & (room(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")) >= need)
    done, tables, last = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), [tried], None
    large = materialised(buckets.where(F.col("size") > LARGE))
    for turn in range(TURNS):
        placed = _mixed(large, of, nodes)
        near = materialised(_neighbours(placed, turn).where(fits & able).select("a", "b", "ra", "rb", "size"))
        expected, total = (near.agg(F.sum("size")).first()[0] or 0) / 2, placed.count()
        discard(placed)
        if expected <= PAIRS * total or last is not None and 2 * expected > last:
            discard(near)
            break
        last = expected
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        each = near.select(*ends, F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).join(done, ["a", "b"], "left_anti")
        asked = materialised(each.groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("x")).select("x.*"))
        discard(near)
        links = materialised(links.unionByName(_similar(docs, asked, shingle, threshold)))
        of, done = components(links), done.unionByName(asked)
        tables.append(asked)
    placed = _mixed(buckets, of, nodes)
    x, y = placed.toDF("h", "a", "na", "pa", "ra", "ba"), placed.toDF("h", "b", "nb", "pb", "rb", "bb")
    met = x.join(y, (x["h"] == y["h"]) & (F.col("a") < F.col("b")) & fits & able).select("a", "b").distinct()
    rest = materialised(met.join(done, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        of = components(links.unionByName(_similar(docs, rest, shingle, threshold)))
    discard(nodes, buckets, large, *tables, placed, rest)
    return rows.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(buckets: DataFrame, of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, node, n, p, root, bits) of the buckets with nodes of more than one component, as a table."""
    placed = buckets.join(of, "node", "left").select("h", "node", "n", "p", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    return materialised(placed.join(mixed, "h", "left_semi").join(nodes.select("node", "bits"), "node").select("h", "node", "n", "p", "root", "bits"))


def _neighbours(placed: DataFrame, turn: int) -> DataFrame:
    """Neighbours in an order of each bucket that is another one for every bucket and turn, with its size:
    one of them stands for half that many pairs."""
    by_h = Window.partitionBy("h")
    before = F.lag(F.struct("node", "n", "p", "root", "bits")).over(by_h.orderBy(F.xxhash64("h", "node", F.lit(turn)), "node"))
    d = placed.withColumn("x", before).withColumn("size", F.count("*").over(by_h)).where("x is not null")
    one = [F.col(f"x.{c}").alias(to) for c, to in zip(("node", "n", "p", "root", "bits"), ("a", "na", "pa", "ra", "ba"), strict=True)]
    return d.select(*one, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("root").alias("rb"), F.col("bits").alias("bb"), "size")


def deduplicate_similar(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one document of each component of ``similar``: the one of the
    smallest doc_id. Of repeated rows with that id and text one stays. Documents without an id are kept."""
    rows = similar(docs, shingle, threshold).where("doc_id is not null")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f")).select("f.*").distinct()
    a, b, *names = fresh(docs, "k1_", "k2_", "id_of_", "k1_of_", "k2_of_")
    one, two = text_key(F.col("text").cast("string"))
    keyed = docs.where("doc_id is not null").withColumns({a: one, b: two})
    kept = keyed.join(first.toDF(*names), [F.col(x) == F.col(y) for x, y in zip(("doc_id", a, b), names, strict=True)], "left_semi")
    return kept.dropDuplicates(["doc_id", a, b]).select(*docs.columns).unionByName(docs.where("doc_id is null"))

"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until
the splitters meet the tolerance, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialised
from .common import fresh

LOWEST = -(2**63)
BITS = 12  # each round cuts an interval into 2**BITS parts
HOT_SHARE = 256  # a key with more than 1/HOT_SHARE of the rows is numbered in parts


@dataclass
class Interval:
    """Keys of one level that may hold a splitter: [lo, lo + 2**bits), with the bytes below.

    ``text`` is None while text keys are cut; inside one text's copies it is that key and
    the interval runs over the keys of the documents."""

    lo: int
    bits: int
    below: int
    text: int | None = None

    def part(self) -> Column:
        key = F.col("k2" if self.text is not None else "k1")
        inside = key >= F.lit(self.lo)
        if self.lo + 2**self.bits < 2**63:
            inside &= key < F.lit(self.lo + 2**self.bits)
        if self.text is not None:
            inside &= F.col("k1") == F.lit(self.text)
        # lo is a multiple of the interval's size, so that xor takes the difference.
        return F.when(inside, F.shiftrightunsigned(key.bitwiseXOR(F.lit(self.lo)), max(self.bits - BITS, 0)))


def keyed(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, size, checksum and the two sort keys. A null text has
    no bytes and the checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k2"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float, whole: float) -> list[tuple[int, int]]:
    """The (text key, document key) at which each shard but the first begins.

    Every round counts bytes in all parts of all open intervals in one pass; at most
    (shards - 1) * 2**BITS rows reach the driver. A splitter is settled at a part's edge that
    lies within ``tolerance`` (a share of a shard) of its target. Copies of a text stay in one
    shard unless they weigh more than ``whole`` of a shard.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    near, keep = tolerance * total / shards, whole * total / shards
    targets = [total * k / shards for k in range(1, shards)]
    found: dict[int, tuple[int, int]] = {}
    open_: dict[int, Interval] = {k: Interval(LOWEST, 64, 0) for k in range(len(targets))}
    while open_:
        intervals = list({(i.lo, i.bits, i.text): i for i in open_.values()}.values())
        place = F.coalesce(*[F.when(i.part().isNotNull(), F.struct(F.lit(n).alias("i"), i.part().alias("p"))) for n, i in enumerate(intervals)])
        counted = (
            rows.select(place.alias("at"), "size", "k1", "k2")
            .where("at is not null")
            .groupBy("at.i", "at.p")
            .agg(F.sum("size").alias("w"), F.min("k1").alias("a"), F.max("k1").alias("z"), F.min("k2").alias("c"), F.max("k2").alias("y"))
            .collect()
        )
        parts: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.i, r.p)):
            parts.setdefault(r.i, []).append(r)
        number = {(i.lo, i.bits, i.text): n for n, i in enumerate(intervals)}
        still = {}
        for k, i in open_.items():
            below = i.below
            for r in parts[number[i.lo, i.bits, i.text]]:
                if below + r.w >= targets[k]:
                    break
                below += r.w
            over = below + r.w
            bits = max(i.bits - BITS, 0)
            lo = i.lo + (r.p << bits)
            gap = min(targets[k] - below, over - targets[k])
            in_text = i.text is not None
            single = r.a == r.z if not in_text else r.c == r.y
            if gap <= near or (single and (in_text or r.w <= keep or r.c == r.y)):
                first = (i.text, r.c) if in_text else (r.a, LOWEST)
                after = (i.text, r.y + 1) if in_text else (r.z + 1, LOWEST)
                found[k] = first if targets[k] - below <= over - targets[k] else after
            elif single:
                still[k] = Interval(LOWEST, 64, below, r.a)
            else:
                still[k] = Interval(lo, bits, below, i.text)
        open_ = still
    return [found[k] for k in range(len(targets))]


def assign(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005, whole: float = 0.02) -> DataFrame:
    """Deal all documents into ``shards`` of nearly equal bytes by the order of their keys.

    ``docs`` has doc_id and text; other columns are not read. Returns doc_id, size (UTF-8
    bytes plus 8; null text: 8), text_crc32, law ('bytes'), shard, slot (gapless in a shard)
    and grown_shard (null: this law does not promise stable growth). Equal texts share a shard
    unless their copies weigh over ``whole`` of a shard; then they are cut by document key.
    Rows with the same id and text are equal keys and stay together. An empty table gives an
    empty result; with fewer documents than shards some shards stay empty.
    """
    rows = materialised(keyed(docs))
    shard = F.lit(0)
    for a, b in splitters(rows, shards, tolerance, whole):
        if a >= 2**63:
            continue
        over = F.col("k1") > F.lit(a)
        at = F.col("k1") == F.lit(a)
        shard = shard + F.when(over | (at if b <= LOWEST else at & (F.col("k2") >= F.lit(b)) if b < 2**63 else F.lit(False)), 1).otherwise(0)
    # Slots: rows are numbered inside ranges of the key and offset by the counts before them, so
    # that no task holds a shard. The copies of a hot text are spread over ranges of their own.
    count = rows.count()
    hot = [r.k1 for r in rows.groupBy("k1").count().where(F.col("count") > max(count // HOT_SHARE, 1)).collect()]
    spread = F.when(F.col("k1").isin(hot), F.shiftright("k2", 56)) if hot else F.lit(None)
    placed = rows.select(
        "*", shard.cast("int").alias("shard"), F.shiftright("k1", 64 - BITS).alias("r1"), F.coalesce(spread, F.lit(-129)).alias("r2")
    )
    ranges = placed.groupBy("shard", "r1", "r2").count()
    before = Window.partitionBy("shard").orderBy("r1", "r2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("shard", "r1", "r2", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "r1", "r2").orderBy("k1", "k2", "doc_id")
    return (
        placed.withColumn("n", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "r1", "r2"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("n")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, files: int = 16) -> None:
    """Write ``docs`` below ``path`` in a folder per shard, ``files`` files each; the whole rows
    move once. Documents with equal id and text lie in the same shard."""
    crc, size, shard = fresh(docs, "text_crc32", "size", "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = docs.withColumns({crc: F.crc32(text), size: (F.octet_length(text) + 8).cast("long")})
    of = assign(docs, shards).select(F.col("doc_id").alias("i"), F.col("text_crc32").alias("c"), F.col("size").alias("s"), F.col("shard").alias(shard)).distinct()
    same = tagged["doc_id"].eqNullSafe(of["i"]) & (tagged[crc] == of["c"]) & (tagged[size] == of["s"])
    joined = tagged.join(of, same).select(*[tagged[c] for c in docs.columns], shard)
    joined.repartition(shard, F.pmod(F.xxhash64("doc_id"), F.lit(files))).write.partitionBy(shard).parquet(path)

"""Phrases that occur often, scored by how much more than their parts would by chance.

Set-oriented mining: the occurrences of phrases of one length are a relation sorted by piece and
position. Its groups are counted; occurrences of groups that are not frequent leave; and what is
left is merged with itself at the next position, which gives the occurrences one word longer.
A relation is a table of blocks, each with the occurrences of whole pieces of a few MB of text, so
the merge needs no exchange; what is exchanged are the distinct phrases of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialised
from .blocks import from_planes, planes
from .common import LOWER, UPPER, small

#: Bytes of text in a block, and of all unfinished blocks of a task (one a language).
BLOCK_BYTES, OPEN_BYTES = 12 << 20, 32 << 20
SLICE_BYTES = 2 << 20
#: So many frequent phrases of one length are sent to all tasks; more are joined by exchange.
BROADCAST_ROWS = 500_000
#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
FOLDED = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
#: ``step`` and ``phrase`` are `blocks.planes`; they are read only as wholes.
RELATION = "group string, block long, occurrences long, step binary, phrase binary, times array<int>"


def _occurrences(texts: list[bytes]) -> dict[str, pa.Array]:
    """Words of all texts: their positions as steps from one to the next (1: neighbours in a piece), what
    stands there as numbers of distinct words, those words, and how often each occurs."""
    chunks, some, size = [], [], 0
    for i, t in enumerate(texts):  # few texts at once as single tokens
        some.append(t)
        size += len(t)
        if size >= SLICE_BYTES or i == len(texts) - 1:
            some.append(b"")
            chunks.append(pa.array(b"\n".join(some).translate(FOLDED).replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode())
            some, size = [], 0
    tokens = pa.chunked_array(chunks).unify_dictionaries()
    dictionary = tokens.chunk(0).dictionary
    values = dictionary.to_pylist()
    code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in tokens.chunks])
    code = code[code != (values.index(b"") if b"" in values else -1)]
    at = np.flatnonzero(code != (values.index(b"\n") if b"\n" in values else -1))
    distinct, phrase, times = _by_frequency(code[at])
    words = dictionary.take(pa.array(distinct)).cast(pa.string())
    return _relation(at, phrase, times) | {"word": _whole(words)}


def _by_frequency(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the most frequent first, each value's number among them, and how often each occurs:
    small numbers for most occurrences leave the higher byte planes nearly empty."""
    distinct, number, times = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[number], times[order]


def _whole(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _relation(at: np.ndarray, phrase: np.ndarray, times: np.ndarray) -> dict[str, pa.Array]:
    packed = {c: pa.array([planes(x)], pa.binary()) for c, x in {"step": np.diff(at, prepend=0), "phrase": phrase}.items()}
    return {"occurrences": pa.array([len(at)])} | packed | {"times": _whole(pa.array(times.astype(np.int32)))}


def words(docs: DataFrame, text: str, group: str) -> DataFrame:
    """The occurrences of single words, as a table of blocks; a block is of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, size, open_bytes = TaskContext.get().partitionId() << 32, {}, {}, 0

        def done(g: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            size.pop(g)
            columns = {"group": pa.array([g]), "block": pa.array([number])} | _occurrences(waiting.pop(g))
            pa.default_memory_pool().release_unused()  # workers are kept, what they once needed should not be
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            for g, t in zip(b.column("group").to_pylist(), b.column("text").to_pylist()):
                waiting.setdefault(g, []).append(t)
                size[g] = size.get(g, 0) + len(t) + 1
                if size[g] >= BLOCK_BYTES:
                    yield done(g)
                elif (open_bytes := open_bytes + len(t) + 64) >= OPEN_BYTES:
                    yield from map(done, list(size))
                    open_bytes = 0
        yield from map(done, list(size))

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("group"), F.encode(value, "utf-8").alias("text"))
    return materialised(rows.mapInArrow(run, f"{RELATION}, word array<string>"), large_rows=True)


def _phrases(relation: DataFrame, keys: list[str]) -> DataFrame:
    """(block, no, keys, times): the distinct phrases of each block. Words have the group as a key; longer
    phrases are named by ids, which belong to one group each."""
    each = relation.select("block", "group", F.posexplode(F.arrays_zip(*[k for k in keys if k != "group"], "times")).alias("no", "z"))
    return each.select("block", "no", *["group" if k == "group" else F.col(f"z.{k}").alias(k) for k in [*keys, "times"]])


def frequent(relation: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, f, id): the phrases with at least ``least`` occurrences, as a table."""
    counted = _phrases(relation, keys).groupBy(*keys).agg(F.sum(F.col("times").cast("long")).alias("f"))
    return materialised(counted.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))


def extended(relation: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """The occurrences one word longer: two occurrences of frequent phrases at neighbouring positions make
    one, named by the ids of both."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        step, phrase = (from_planes(left.column(c)[0].as_py()) for c in ("step", "phrase"))
        no, ids = right.column("no").to_numpy(), right.column("id").to_numpy()
        rank = np.full(int(phrase.max(initial=0)) + 1, -1, np.int64)
        rank[no] = np.arange(len(no))
        at, kept = np.cumsum(step, dtype=np.int64), rank[phrase]
        at, kept = at[kept >= 0], kept[kept >= 0]
        i = np.flatnonzero(np.diff(at) == 1)
        pair, longer, times = _by_frequency(kept[i] * max(len(no), 1) + kept[i + 1])
        a, b = np.divmod(pair, max(len(no), 1))
        made = _relation(at[i], longer, times) | {"first": _whole(pa.array(ids[a], pa.int64())), "last": _whole(pa.array(ids[b], pa.int64()))}
        return pa.table({"group": left.column("group"), "block": left.column("block")} | made)

    named = _phrases(relation, keys).drop("times").join(small(known.select(*keys, "id"), BROADCAST_ROWS), keys)
    named = named.select(*[F.col(c).alias(c) for c in ("block", "no", "id")])  # own columns, though both stem from the relation
    both = relation.select("group", "block", "step", "phrase").groupBy("block").cogroup(named.groupBy("block"))
    return materialised(both.applyInArrow(run, f"{RELATION}, first array<long>, last array<long>"), large_rows=True)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", group: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(group, words, f) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences in their
    group, and (group, n), the words of each group. The frequent ones are tables."""
    relation = words(docs, text, group)
    totals = materialised(relation.groupBy("group").agg(F.sum("occurrences").alias("n")))
    keys, levels = ["group", "word"], []
    for length in range(1, longest + 1):
        known = frequent(relation, keys, least)
        if length == 1:
            named = known.select("group", "id", F.array("word").alias("words"), "f")
        else:
            before = levels[-1]
            first = before.select("group", F.col("id").alias("first"), F.col("words").alias("head"))
            last = before.select(F.col("id").alias("last"), F.element_at("words", -1).alias("tail"))
            named = known.join(first, "first").join(last, "last")
            named = named.select("group", "id", F.concat("head", F.array("tail")).alias("words"), "f")
        levels.append(materialised(named))
        if length == longest or levels[-1].isEmpty():
            discard(relation, known)
            break
        longer = extended(relation, keys, known)
        discard(relation, known)
        relation, keys = longer, ["first", "last"]
    return reduce(DataFrame.unionAll, [level.select("group", "words", "f") for level in levels]), totals


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def score() -> Column:
    """floor(1000 a n / (l r)) of whole numbers, exact where products pass 64 bits."""
    return F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    covered_percent: int = 100,
    limit: int | None = 2000,
    text: str = "text",
    group: str = "lang",
) -> DataFrame:
    """The best phrases of every group (null: ``und``), found in whole texts.

    Texts (null: empty) in which A-Z are lower-cased are cut into pieces at .,;:!? and ends of lines, pieces into
    words at spaces and tabs; phrases lie within pieces, and all occurrences count, overlapping ones too. Candidates
    have 2 to ``longest`` words and a >= ``least`` occurrences. A candidate's score is the least
    floor(1000 a n / (l r)) over its cuts into parts with l and r occurrences, n being the words of the group;
    of equal cuts the one with the shorter first part counts. Candidates inside a longer one that has at least
    ``covered_percent`` of their occurrences go. Returns group, rank (by score, then a, both falling, then
    phrase in byte order), phrase, a, l, r, n, score, for ranks up to ``limit`` (None: all).
    Repeated rows count each; ids are not read; an empty table gives an empty result.
    """
    known, totals = frequent_phrases(docs, least, longest, text, group)
    counts = known.select("group", _joined(F.col("words")).alias("phrase"), "f")
    candidates = known.where(F.size("words") > 1).select("group", "words", _joined(F.col("words")).alias("phrase"), F.col("f").alias("a"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: _joined(F.slice("words", at, size))),
        )
    )
    around = (
        candidates.where(F.size("words") > 2)
        .select("group", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("group", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    covered = candidates.join(around, ["group", "phrase"]).where(100 * F.col("longer") >= covered_percent * F.col("a"))
    free = candidates.join(covered.select("group", "phrase"), ["group", "phrase"], "left_anti")

    cut = free.select("group", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("group", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("head"), _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    part = lambda name, f: counts.select("group", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("head", "l"), ["group", "head"]).join(part("rest", "r"), ["group", "rest"]).join(totals, "group")
    best = (
        cut.groupBy("group", "phrase", "a", "n")
        .agg(F.min(F.struct(score().alias("score"), "k", "l", "r")).alias("cut"))
        .select("group", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

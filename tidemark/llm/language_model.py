"""A byte-level language model by context-tree weighting.

A text is its words (A-Z lower-cased), each followed by a space, and then a newline, so that it
is exactly the token sequence a unigram model sees. Each byte is eight binary decisions. A
decision's context are the last ``depth`` bytes, of which up to ``TAIL`` may belong to the word
before. Every node of the context tree estimates a decision by Krichevsky-Trofimov counts and
mixes that with what the deeper nodes say, in the proportion in which either predicted the
training texts: P_w = (P_kt + P_w of the children) / 2. The counts come from all training texts.

A token's code length splits in two: its first ``HEAD`` bytes depend on the tail of the word
before (a "head"), the others on the word alone. Either is computed once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialised
from . import blocks
from .common import remainder

DEPTH = 6
TAIL = 2
HEAD = DEPTH - 1  # bytes whose context reaches the word before
END = b"\n"
TOP = 2  # contexts of up to so many bytes lie above the subtrees
CUT = 3  # a task works its subtrees in pieces that are whole for contexts of so many bytes
#: A piece has about so many grams.
PIECE = 100_000
#: Terms are scored in blocks of about so many (term, block of documents) pairs.
TERM_REFS = 250_000
#: They are dealt to parts of at most about so many, and small corpora to so many parts for the sake of parallel work.
PART_REFS, LEAST_PARTS = 2_000_000, 16


def tokens(texts: pa.Array) -> pa.ListArray:
    """Words and heads of A-Z lower-cased texts, cut at the six ASCII white-space characters.

    A head is a space, the tail of the word before, a space, and the first HEAD bytes of the
    word and its closing space (of the end: a newline). Words never hold a space.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten().cast(pa.binary())
    full = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()]
    words, sizes = flat.filter(full), np.diff(ends)
    n, docs = len(words), np.arange(len(texts))
    first = np.zeros(n + 1, bool)
    first[ends[:-1]] = True
    tails = pc.binary_slice(words, -TAIL)
    before = np.arange(n) - 1
    before = pa.array(before, mask=first[:n] if n else None)
    space, none = pa.scalar(b" "), pa.scalar(b"")
    start = pc.binary_slice(pc.binary_join_element_wise(words, space, none), 0, HEAD)
    heads = pc.binary_join_element_wise(space, pc.fill_null(tails.take(before), b""), space, start, none)
    last = tails.take(pa.array(ends[1:] - 1, mask=sizes == 0))
    closing = pc.binary_join_element_wise(space, pc.fill_null(last, b""), pa.scalar(b" " + END), none)
    of = np.repeat(docs, sizes)
    order = np.argsort(np.concatenate([of, of, docs]), kind="stable")
    values = pa.concat_arrays([words, heads, closing]).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * sizes + 1)]).astype(np.int32)), values)


def grams(terms: pa.Array, depth: int = DEPTH) -> pa.ListArray:
    """Context * 256 + byte, the nearest byte lowest, of the bytes that a term stands for: all of
    a head's after its second space, a word's (closing space included) from byte HEAD on."""
    raw, skip = [], []
    for t in terms.to_pylist():
        raw.append(t[1:] if t[0] == 32 else b" " + t + b" ")
        skip.append(t.index(b" ", 1) if t[0] == 32 else 1 + HEAD)
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = data.copy()
    for back in range(1, depth + 1):
        out[back:] |= np.where(at[back:] >= back, data[:-back], 0) << (8 * back)
    skip = np.minimum(np.array(skip, np.int64), sizes)
    used = at >= np.repeat(skip, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes - skip)]).astype(np.int32)), pa.array(out[used]))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0 by Stirling's series at x + 8."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of any order of so many zeros and ones under the KT estimator."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: their keys (context * 256 + prefix of the byte's bits), counts, and logs."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.below, kt = below, log_kt(zeros, ones)
        self.weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.own = None if below is None else 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
        self.one = (ones + 0.5) / (zeros + ones + 1)


def up(level: Level, depth: int) -> tuple[Level, np.ndarray]:
    """The nodes one byte of context above, and each node's parent among them."""
    context, prefix = level.keys >> 8, level.keys & 255
    keys, parent = np.unique((context & ((1 << (8 * (depth - 1))) - 1)) << 8 | prefix, return_inverse=True)
    n = len(keys)
    return Level(keys, np.bincount(parent, level.zeros, n), np.bincount(parent, level.ones, n), np.bincount(parent, level.weighted, n)), parent


def subtrees(gram: np.ndarray, count: np.ndarray, depth: int, top: int):
    """The levels from ``depth`` to ``top`` for whole subtrees: (states of each gram's eight
    decisions at the deepest level, their bits, the top level, each deepest state's node there,
    and its probability of a one as seen from the top level)."""
    byte, step = gram & 255, np.arange(8)
    prefix = (1 << step) | (byte[:, None] >> (8 - step))
    bits = (byte[:, None] >> (7 - step)) & 1
    keys, state = np.unique(((gram[:, None] >> 8) << 8 | prefix).ravel(), return_inverse=True)
    weight = np.repeat(count, 8).astype(float)
    ones = np.bincount(state, weight * bits.ravel(), len(keys))
    level = Level(keys, np.bincount(state, weight, len(keys)) - ones, ones, None)
    one, node = level.one, np.arange(len(keys))
    for d in range(depth, top, -1):
        level, parent = up(level, d)
        node = parent[node]
        one = level.own[node] * level.one[node] + (1 - level.own[node]) * one
    return state.reshape(-1, 8), bits, level, node, one


def _pieces(batches: Iterator[pa.RecordBatch], cut: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of a task in pieces of about PIECE, none of which parts the grams of one
    context of ``cut`` bytes. Eight decisions for each gram are then held for one piece only."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return []
    rows = pa.Table.from_batches(parts)
    gram, count = rows.column("gram").to_numpy(), rows.column("count").to_numpy()
    key = (gram >> 8) & ((1 << (8 * cut)) - 1)
    order = np.argsort(key, kind="stable")
    gram, count, key = gram[order], count[order], key[order]
    ends = np.flatnonzero(np.diff(key, append=-1)) + 1
    ends = ends[np.flatnonzero(np.diff((ends - 1) // PIECE, append=-1))]
    return [(gram[i:j], count[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def _tops(pieces: list[tuple[np.ndarray, np.ndarray]], depth: int, cut: int) -> Level:
    """The nodes at TOP bytes of context of all pieces."""
    levels = [subtrees(*piece, depth, cut)[2] for piece in pieces]
    keys, zeros, ones = (np.concatenate([getattr(x, c) for x in levels]) for c in ("keys", "zeros", "ones"))
    level = Level(keys, zeros, ones, None if cut == depth else np.concatenate([x.below for x in levels]))
    return up(level, cut)[0] if cut > TOP else level


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, lp): log10 probability of a byte after its context, for (gram, count) rows.

    Rows are dealt by the last two bytes of the context, so that a task has whole subtrees; it
    returns the counts and weights of their roots, which sum up to at most 256 * 255 nodes of
    one byte and 255 of none. With those, the second pass mixes down to the root.
    """
    cut = min(CUT, depth)
    dealt = counts.repartition(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1)))

    def roots(batches):
        if pieces := _pieces(batches, cut):
            level = _tops(pieces, depth, cut)
            columns = [level.keys, level.zeros, level.ones, level.weighted]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "zeros", "ones", "weighted"])

    found = dealt.mapInArrow(roots, "node long, zeros double, ones double, weighted double")
    parent = F.col("node").bitwiseAND(F.lit(0xFFFF))  # one byte of context and the bits
    sums = found.groupBy(parent.alias("node")).agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("node").collect()
    one_byte = Level(*(np.array([r[i] for r in sums], np.int64 if i == 0 else float) for i in range(4)))
    root = up(one_byte, 1)[0]

    def scores(batches):
        if not (pieces := _pieces(batches, cut)):
            return
        tops = _tops(pieces, depth, cut)
        for gram, count in pieces:
            state, bits, level, node, one = subtrees(gram, count, depth, cut)
            for above in ([tops] if cut > TOP else []) + [one_byte, root]:
                mask = 0xFFFFFF if above is tops else 0xFFFF if above is one_byte else 0xFF
                at = np.searchsorted(above.keys, level.keys & mask)[node]
                one = above.own[at] * above.one[at] + (1 - above.own[at]) * one
            p = np.where(bits == 1, one[state], 1 - one[state])
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.log10(p).sum(axis=1).astype(np.float32))], names=["gram", "lp"])

    return dealt.mapInArrow(scores, "gram long, lp float")


def dealt_terms(made: DataFrame, parts: int) -> DataFrame:
    """(part, block, pos, size, weight, text): the distinct terms of each block of documents, dealt by their crc32.

    A row has all terms of one block and part, as compressed arrays: what is exchanged are a few bytes
    a term, and no row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                terms, weight = (b.column(c).slice(i, 1).flatten() for c in ("terms", "weights"))
                hashes = np.fromiter(map(crc32, terms.to_pylist()), np.int64, len(terms)) % parts
                order = np.argsort(hashes.astype(np.min_scalar_type(parts)), kind="stable")
                found = np.flatnonzero(np.bincount(hashes, minlength=parts))
                ends = np.searchsorted(hashes[order], found, "right")
                out = []
                for at in np.split(order, ends[:-1]):
                    some = terms.take(pa.array(at))
                    size = pc.binary_length(some).to_numpy(zero_copy_only=False)
                    text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), b"")[0].as_py() if len(some) else b""
                    text = len(text).to_bytes(8, "little") + blocks.CODEC.compress(text, asbytes=True)
                    out.append((blocks.planes(np.diff(at, prepend=0)), blocks.planes(size), blocks.planes(weight.take(pa.array(at)).to_numpy()), text))
                if len(order):
                    columns = [pa.array(found, pa.int64()), pa.array([block] * len(found), pa.int64())]
                    columns += [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "pos", "size", "weight", "text"])

    return made.select("block", "terms", "weights").mapInArrow(run, "part long, block long, pos binary, size binary, weight binary, text binary")


def _texts(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows of ``dealt_terms``, one after another, and how many each row has."""
    packed = rows.column("text").to_pylist()
    data = b"".join(pa.decompress(t[8:], int.from_bytes(t[:8], "little"), "zstd", asbytes=True) for t in packed)
    sizes = [blocks.from_planes(x) for x in rows.column("size").to_pylist()]
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.array([len(x) for x in sizes])


def term_blocks(made: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Distinct terms in blocks, from the terms of ``blocks.encode``, as a table.

    All rows of a term meet in one part and in one block: their weights are summed, and the block
    keeps where each came from. Its distinct grams are listed once with their counts. A part is
    a fixed number of references, so it does not grow with the corpus; its blocks are cut in the order of
    the terms, as neighbours have grams in common."""
    refs = made.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    parts = max(-(-refs // PART_REFS), min(-(-refs // TERM_REFS), LEAST_PARTS), 1)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        values, count = _texts(rows)
        coded = values.dictionary_encode()
        by_term = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        term = rank[coded.indices.to_numpy()]
        distinct = coded.dictionary.take(pa.array(by_term))
        del values, coded
        block = np.repeat(rows.column("block").to_numpy(), count)
        pos = np.concatenate([np.cumsum(blocks.from_planes(x)) for x in rows.column("pos").to_pylist()])
        weight = np.concatenate([blocks.from_planes(x) for x in rows.column("weight").to_pylist()])
        order = np.argsort(term, kind="stable")
        upto = np.cumsum(np.bincount(term, minlength=len(distinct)))
        last = np.flatnonzero(np.diff((upto - 1) // TERM_REFS, append=-1))  # terms after which a block ends
        out, first = [], 0
        for number, t in enumerate(last):
            at = order[(upto[first - 1] if first else 0) : upto[t]]
            name = (key[0].as_py() << 24) + number
            out.append(_term_block(distinct.slice(first, t + 1 - first), term[at] - first, block[at], pos[at], weight[at], name, depth))
            first = t + 1
            pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    schema = "tb long, terms array<long>, weights array<long>, at binary, owner binary, count binary, term binary, blocks binary, block binary, pos binary, n long, v long"
    return materialised(dealt_terms(made, parts).groupBy("part").applyInArrow(run, schema))


def _term_block(distinct: pa.Array, term: np.ndarray, block: np.ndarray, pos: np.ndarray, weight: np.ndarray, name: int, depth: int) -> pa.RecordBatch:
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, term, weight)
    lists = grams(distinct, depth)
    sizes = np.diff(lists.offsets.to_numpy())
    gram, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(distinct)), sizes)
    weights = np.zeros(len(gram), np.int64)
    np.add.at(weights, at, count[owner])
    word = pc.not_equal(pc.binary_slice(distinct, 0, 1), pa.scalar(b" ", distinct.type)).to_numpy(zero_copy_only=False)
    known = word & (count > 0)
    source, of = np.unique(block, return_inverse=True)
    raw = [
        blocks.planes(at), blocks.planes(np.diff(owner, prepend=0)), np.where(word, count, -1).astype("<i8").tobytes(),
        blocks.planes(np.diff(term, prepend=0)), source.astype("<i8").tobytes(), blocks.planes(of), blocks.planes(pos),
    ]
    columns = [pa.array([name]), blocks.whole(pa.array(gram)), blocks.whole(pa.array(weights))]
    columns += [pa.array([x], pa.binary()) for x in raw] + [pa.array([int(count[known].sum())]), pa.array([int(known.sum())])]
    names = ["tb", "terms", "weights", "at", "owner", "count", "term", "blocks", "block", "pos", "n", "v"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def term_scores(made: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(block, packed), as a table: for each place (pos) a term came from its training count (-1: a head; as
    two halves) and the log10 probability (lp) of the bytes it stands for, those of one block of
    documents packed. Terms of count 0 were not learned from."""
    each = blocks.terms(made.withColumnRenamed("block", "b").withColumnRenamed("tb", "block").select("block", "terms", "weights"))
    each = each.withColumnsRenamed({"block": "tb", "term": "gram"})
    counts = materialised(each.groupBy("gram").agg(F.sum("weight").alias("count")))
    values = each.join(gram_scores(counts, depth), "gram").select(F.col("tb").alias("tb"), F.col("pos").alias("p"), "lp")

    def run(key, left, right):
        row = {c: left.column(c)[0].as_py() for c in ("at", "owner", "count", "term", "blocks", "block", "pos")}
        at, owner = blocks.from_planes(row["at"]), np.cumsum(blocks.from_planes(row["owner"]))
        count, term = np.frombuffer(row["count"], "<i8"), np.cumsum(blocks.from_planes(row["term"]))
        lp = np.zeros(int(at.max()) + 1 if len(at) else 1)
        if right.num_rows:
            lp[right.column("p").to_numpy()] = right.column("lp").to_numpy()
        total = np.bincount(owner, lp[at], len(count))
        pa.default_memory_pool().release_unused()
        block, pos = np.frombuffer(row["blocks"], "<i8")[blocks.from_planes(row["block"])], blocks.from_planes(row["pos"])
        order = np.lexsort((pos, block))
        term = term[order]
        block, packed = blocks.pack(block[order], pos[order], *count[term].view("<i4").reshape(-1, 2).T, total[term].astype("<f4"))
        return pa.table({"block": block, "packed": packed})

    kept = made.select("tb", "at", "owner", "count", "term", "blocks", "block", "pos")
    out = materialised(kept.groupBy("tb").cogroup(values.groupBy("tb")).applyInArrow(run, "block long, packed binary"))
    discard(counts)
    return out


def _unpacked(values: pa.Table) -> dict[str, np.ndarray]:
    pos, low, high, lp = blocks.unpack(values.column("packed"), 4)
    count = np.stack([low, high], axis=1).view("<i8").ravel()
    return {"pos": pos, "count": count, "lp": np.ascontiguousarray(lp).view("<f4").astype(float)}


def score(docs: DataFrame, modulus: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """Score every document, learning from those whose crc32(doc_id) mod ``modulus`` isn't ``held``.

    Reads doc_id and text. Returns doc_id, held_out, n_tokens (words and one end), n_known
    (tokens seen in training), train_tokens, base_score (add-one unigram log10 probability),
    score (log10 probability under the model) and bits_per_byte (code length by byte of the
    text; null without bytes). A null or empty text has its end only. Without training
    documents no token is known, the base gives each token probability 1 and the model 1/2 per
    decision. Repeated rows are learned from and returned each.
    """
    docs = docs.select("doc_id", "text")
    learn = remainder(F.col("doc_id"), modulus) != held
    made = blocks.encode(docs, tokens, learn, "binary")
    distinct = term_blocks(made, depth)
    # From here on the terms are in blocks of their own; what is read no more is deleted, as all of it takes several times the input.
    kept = materialised(made.select("block", "docs", "indptr", "at", "freq"))
    discard(made)
    zero = F.lit(0)
    n, v = distinct.agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("v"), zero)).first()
    ends = docs.agg(F.coalesce(F.sum(learn.cast("long")), zero)).first()[0]
    n, v = n + ends, v + (ends > 0)
    bottom = float(np.log10(n + v + 1))

    def finish(take, weight, n_bytes, n_terms):
        total = take("lp")
        return {
            "held_out": weight == 0,
            "n_tokens": (n_terms + 1) // 2,
            "n_known": take("count", lambda c: c > 0).astype(np.int64) + int(ends > 0),
            "train_tokens": np.full(len(weight), n, np.int64),
            "base_score": take("count", lambda c: np.where(c < 0, 0, np.log10(np.maximum(c, 0) + 1) - bottom)) + float(np.log10(ends + 1)) - bottom,
            "score": total,
            "bits_per_byte": np.where(n_bytes > 0, -total / np.log10(2) / np.maximum(n_bytes, 1), np.nan),
        }

    schema = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    scores = term_scores(distinct, depth)
    discard(distinct)
    out = blocks.per_document(kept, scores, finish, docs.schema["doc_id"].dataType.simpleString(), schema, _unpacked)
    return out.withColumn("bits_per_byte", F.nanvl("bits_per_byte", F.lit(None).cast("double")))

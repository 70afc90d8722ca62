"""Documents in blocks of term frequencies, and values of distinct terms brought back to them.

A block holds the documents of a few MB of text: its distinct terms once, and for each document
its terms as positions in that list with their frequencies. Terms are shuffled once per block
instead of once per document and occurrence, what is known of a distinct term comes back
under the term's position, and per-document sums are taken inside the block. The size of a
block is fixed, so neither grows with the corpus, however frequent a term is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised

BLOCK_BYTES = 12 << 20
#: A block also ends at so many documents, for tables of very short texts.
BLOCK_DOCS = 16_384
SLICE = 512
#: At this level zstd makes 5 to 15 % less of positions and numbers than at its lowest, for a second more a GB of text.
CODEC = pa.Codec("zstd", compression_level=6)
NAMES = ["block", "n_terms", "docs", "terms", "weights", "indptr", "at", "freq"]


def encode(
    docs: DataFrame,
    tokenise: Callable[[pa.Array], pa.ListArray],
    weight: Column | None = None,
    term_type: str = "string",
) -> DataFrame:
    """One row per block of documents (doc_id, text), as a table in the shared folder.

    ``tokenise`` maps texts (null: empty; bytes, if the column has bytes) to lists of terms of ``term_type``. ``weights`` counts
    each term, an occurrence as often as its document's ``weight`` (a long, 1 if not given).
    Ids are kept in Arrow's own format, so any type will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        waiting, size, count = [], 0, 0
        for b in batches:
            start = 0
            for i, s in enumerate(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)):
                size, count = size + int(s), count + 1
                if size >= BLOCK_BYTES or count >= BLOCK_DOCS:
                    yield _block([*waiting, b.slice(start, i + 1 - start)], (task << 24) + number, tokenise)
                    waiting, size, count, start, number = [], 0, 0, i + 1, number + 1
            if start < b.num_rows:
                waiting.append(b.slice(start))
        if waiting:
            yield _block(waiting, (task << 24) + number, tokenise)

    weight = F.lit(1) if weight is None else weight
    text = F.col("text") if docs.schema["text"].dataType.typeName() == "binary" else F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), weight.cast("long").alias("weight"))
    schema = f"block long, n_terms long, docs binary, terms array<{term_type}>, weights array<long>, indptr binary, at binary, freq binary"
    return materialised(rows.mapInArrow(run, schema))


def planes(x: np.ndarray) -> bytes:
    """32-bit integers, first all lowest bytes, then all second ones, after their length compressed: such
    arrays are exchanged whole, and a shuffle's own codec makes less of them."""
    raw = x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def from_planes(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pack(group: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(group, packed): the 32-bit columns of each run of equal ``group`` as one binary, in byte planes."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    size, width = np.diff(first, append=len(group)), 4 * len(columns)
    to = np.arange(len(group)) + np.repeat((width - 1) * first, size)
    raw, out = np.stack([np.ascontiguousarray(c).view("<i4") for c in columns], axis=1).view(np.uint8), np.empty(width * len(group), np.uint8)
    for plane in range(width):
        out[to + plane * np.repeat(size, size)] = raw[:, plane]
    offsets = pa.array(np.append(first, len(group)) * width, pa.int32())
    return group[first], pa.Array.from_buffers(pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(out)])


def unpack(packed: pa.Array | pa.ChunkedArray, n_columns: int) -> list[np.ndarray]:
    """The 32-bit columns (as integers) of all binaries of ``pack``, one after another."""
    width = 4 * n_columns
    data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    size = pc.binary_length(packed).to_numpy().astype(np.int64) // width
    n, size_of = int(size.sum()), np.repeat(size, size)
    at = np.arange(n) + np.repeat((width - 1) * (np.cumsum(size) - size), size)
    rows = np.stack([data[at + plane * size_of] for plane in range(width)], axis=1)
    return list(np.ascontiguousarray(rows).view("<i4").T)


def whole(values: pa.Array) -> pa.Array:
    """All values as the one list of a one-row column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(parts: list[pa.RecordBatch], name: int, tokenise) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    text, weight = (rows.column(c).combine_chunks() for c in ("text", "weight"))
    chunks, freqs, sizes = [], [], []
    for i in range(0, len(text), SLICE):  # few texts at once as single tokens
        lists = tokenise(text.slice(i, SLICE))
        coded = lists.flatten().dictionary_encode()
        lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
        v = max(len(coded.dictionary), 1)
        doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        pairs, freq = np.unique(doc * v + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        of, at = np.divmod(pairs, v)
        chunks.append(pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), coded.dictionary))
        freqs.append(freq.astype(np.int32))
        sizes.append(np.bincount(of, minlength=len(lengths)))
    coded = pa.chunked_array(chunks).unify_dictionaries()
    terms, freq = coded.chunk(0).dictionary, np.concatenate(freqs)
    at = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
    del chunks, coded
    size = np.concatenate(sizes)
    weights = np.zeros(len(terms), np.int64)
    np.add.at(weights, at, np.repeat(weight.fill_null(0).to_numpy(zero_copy_only=False), size) * freq)
    indptr = np.concatenate([[0], np.cumsum(size)]).astype("<i8")
    sink = pa.BufferOutputStream()
    kept = pa.table({"doc_id": rows.column("doc_id"), "weight": weight, "n_bytes": pc.cast(pc.binary_length(text), pa.int64())})
    with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(kept)
    # Terms are numbered in order of appearance, so the steps from one to the next are small.
    raw = [pa.array([x], pa.binary()) for x in (indptr.tobytes(), planes(np.diff(at, prepend=0)), planes(freq))]
    columns = [pa.array([name], pa.int64()), pa.array([len(terms)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), whole(terms), whole(pa.array(weights)), *raw]
    pa.default_memory_pool().release_unused()  # workers are kept, what they once needed should not be
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def terms(blocks: DataFrame) -> DataFrame:
    """(block, pos, term, weight): the distinct terms of each block."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("terms", "weights")).alias("pos", "z"))
    return each.select("block", "pos", F.col("z.terms").alias("term"), F.col("z.weights").alias("weight"))


def _plain(values: pa.Table) -> dict[str, np.ndarray]:
    return {c: values.column(c).to_numpy() for c in values.column_names if c != "block"}


def per_document(
    blocks: DataFrame,
    values: DataFrame,
    finish: Callable[..., dict[str, np.ndarray]],
    id_type: str,
    schema: str,
    decode: Callable[[pa.Table], dict[str, np.ndarray]] = _plain,
) -> DataFrame:
    """Bring (block, pos, value columns) back to their blocks and return rows per document.

    ``decode`` makes pos and the value columns of what else the rows of a block hold.

    ``finish(take, weight, n_bytes, n_terms)`` returns the columns of ``schema``, which follow
    doc_id; ``take(column, f)`` is the sum of frequency times f(value) over each document's terms.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("docs", "indptr", "at", "freq")}
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        indptr, at, freq = np.frombuffer(row["indptr"], "<i8"), np.cumsum(from_planes(row["at"])), from_planes(row["freq"])
        of = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
        got = decode(right) if right.num_rows else None

        def sums(x: np.ndarray) -> np.ndarray:
            return np.bincount(of, x, minlength=len(indptr) - 1)

        def take(column: str, f=lambda x: x) -> np.ndarray:
            value = np.zeros(int(at.max()) + 1 if len(at) else 1)
            if got:
                value[got["pos"]] = f(got[column])
            return sums(value[at] * freq)

        weight = docs.column("weight").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        pa.default_memory_pool().release_unused()
        out = finish(take, weight, docs.column("n_bytes").to_numpy(), sums(freq).astype(np.int64))
        return pa.table({"doc_id": docs.column("doc_id")} | {n: pa.array(out[n]) for n in names})

    kept = blocks.select("block", "docs", "indptr", "at", "freq")
    renamed = values.select(*[F.col(c).alias(c) for c in values.columns])  # own columns, though both stem from the blocks
    return kept.groupBy("block").cogroup(renamed.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, {schema}")

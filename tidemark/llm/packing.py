"""Packing of token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at once, and how many sequences a task keeps open."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    open: int = 32


class Packer:
    """Places pieces of examples into open sequences.

    An example is a stretch of tokens of which some bear loss. It goes into the open sequence
    that has room for all of it and whose free room (tokens, segments, loss, each as a share
    of its limit) has the largest dot product with what the example needs. If none has room and
    no more may be opened, the example is cut so that it fills the fullest one. Finished
    sequences come out as lists of (example, start, length).
    """

    def __init__(self, limits: Limits, loss_of: Callable[[int, int, int], int]):
        self.limits, self.loss_of = limits, loss_of
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.room = np.zeros((0, 3))
        self.held: list[list[tuple[int, int, int]]] = []
        self.done: list[list[tuple[int, int, int]]] = []

    def _fits(self, example: int, start: int, length: int, room: np.ndarray) -> int:
        """The longest prefix of a piece that ``room`` takes."""
        if room[1] < 1:
            return 0
        n = int(min(length, room[0]))
        if self.loss_of(example, start, n) <= room[2]:
            return n
        low = 0
        while low < n:  # loss grows with the prefix
            mid = (low + n + 1) // 2
            low, n = (mid, n) if self.loss_of(example, start, mid) <= room[2] else (low, mid - 1)
        return low

    def _put(self, k: int, example: int, start: int, length: int) -> None:
        self.held[k].append((example, start, length))
        self.room[k] -= (length, 1, self.loss_of(example, start, length))
        if self.room[k, 0] < 1:
            self._close(k)
        elif self.room[k].min() < 1:
            self._spill(k)

    def _close(self, k: int) -> None:
        self.done.append(self.held.pop(k))
        self.room = np.delete(self.room, k, axis=0)

    def add(self, example: int, length: int) -> None:
        start = 0
        while start < length:
            left = length - start
            n = self._fits(example, start, left, self.cap)
            if n == self.limits.tokens:  # fills a sequence by itself
                self.done.append([(example, start, n)])
                start += n
                continue
            need = np.array([left, 1, self.loss_of(example, start, left)], float)
            fit = (self.room >= need).all(axis=1)
            if fit.any():
                gain = (self.room / self.cap) @ (need / self.cap)
                self._put(int(np.argmax(np.where(fit, gain, -1))), example, start, left)
                return
            if len(self.held) < self.limits.open:
                self.room = np.vstack([self.room, self.cap])
                self.held.append([])
                self._put(len(self.held) - 1, example, start, n)
                start += n
                continue
            k = int(np.argmin(self.room[:, 0]))
            n = self._fits(example, start, left, self.room[k])
            if n:
                self._put(k, example, start, n)
                start += n
            else:
                self._spill(k)

    def _spill(self, k: int) -> None:
        """Close a sequence that takes nothing more without padding it."""
        pieces = self.held[k]
        self._close(k)
        del self.done[-1]
        self._recut(pieces)

    def finish(self) -> None:
        """Cut what is still open into full sequences and sequences of a power of two."""
        pieces = [p for held in self.held for p in held]
        self.held, self.room = [], np.zeros((0, 3))
        self._recut(pieces)

    def _recut(self, pieces: list[tuple[int, int, int]]) -> None:
        pieces = pieces[::-1]
        while pieces:
            room, cur = self.cap.copy(), []
            while pieces and room.min() >= 1:
                example, start, length = pieces.pop()
                n = self._fits(example, start, length, room)
                if n:
                    cur.append((example, start, n))
                    room -= (n, 1, self.loss_of(example, start, n))
                if n < length:
                    pieces.append((example, start + n, length - n))
                    break
            size = sum(p[2] for p in cur)
            keep = size if size == self.limits.tokens else 1 << (size.bit_length() - 1)
            taken, out = 0, []
            for example, start, length in cur:
                n = min(length, keep - taken)
                if n:
                    out.append((example, start, n))
                    taken += n
                if n < length:
                    pieces.append((example, start + n, length - n))
            self.done.append(out)


def pack(examples: DataFrame, limits: Limits, read: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray | None]]], id_type: str) -> DataFrame:
    """Pack all rows of ``examples`` (doc_id and what ``read`` needs).

    ``read`` turns a batch into (ids, loss mask) per row; no mask means that each token bears
    loss. Every task packs the rows of its own partition, holding at most ``limits.open``
    unfinished sequences, and cuts those to powers of two at its end, so nothing is padded and no
    row moves. Sequence ids are the task's number and a count; a repeated task gives the same.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, given = TaskContext.get().partitionId(), 0
        alive: dict[int, tuple] = {}  # example -> doc_id, ids, loss counted up to each token, tokens not yet returned
        number = 0

        def loss_of(example: int, start: int, length: int) -> int:
            sums = alive[example][2]
            return length if sums is None else int(sums[start + length] - sums[start])

        packer = Packer(limits, loss_of)

        def drain() -> list[tuple]:
            nonlocal given
            rows = []
            for sequence in packer.done:
                offset = 0
                for example, start, length in sequence:
                    doc, ids, _, _ = alive[example]
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc, start, length, crc, len(ids), (task << 40) + given, offset, loss_of(example, start, length)))
                    offset += length
                    alive[example][3][0] -= length
                given += 1
                for example, _, _ in sequence:
                    if example in alive and alive[example][3][0] == 0:
                        del alive[example]
            packer.done.clear()
            return rows

        def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=names)

        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            rows = []
            for doc, (ids, mask) in zip(b.column("doc_id").to_pylist(), read(b), strict=True):
                sums = None if mask is None else np.concatenate([[0], np.cumsum(mask)])
                if len(ids):
                    alive[number] = (doc, ids, sums, [len(ids)])
                    packer.add(number, len(ids))
                    number += 1
                    rows += drain()
            yield batch(rows, kind)
        packer.finish()
        if kind is not None:
            yield batch(drain(), kind)

    return examples.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]))


def byte_bpe(ranks: str, pattern: str, special: dict[str, int]):
    """A byte-level BPE from a file of ranks, with the special strings found inside texts."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)


def pack_documents(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], limits: Limits | None = None, end: int = 0) -> DataFrame:
    """Pack whole documents, each followed by the id ``end``.

    Reads doc_id and text. A null or empty text is the end id alone; repeated rows are packed
    each; an empty table gives an empty result. The ids are those of the same vocabulary's
    slower tokenizer file (checked in the tests).
    """
    limits = limits or Limits()

    def reader():
        encoding = []

        def read(b: pa.RecordBatch) -> list[tuple[np.ndarray, None]]:
            if not encoding:
                encoding.append(byte_bpe(ranks, pattern, special))
            out = []
            for text in b.column("text").to_pylist():
                ids = encoding[0].encode_to_numpy(text or "", allowed_special="all")
                out.append((np.append(ids, end).astype("<u4"), None))
            return out

        return read

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return pack(rows, limits, reader(), docs.schema["doc_id"].dataType.simpleString())


def pack_conversations(turns: DataFrame, ranks: str, pattern: str, special: dict[str, int], limits: Limits | None = None, end: int = 0) -> DataFrame:
    """Pack conversations (conv_id, turn, role, text): turns in order, each followed by ``end``;
    only the tokens of assistant turns bear loss. doc_id of the result is conv_id."""
    limits = limits or Limits()
    encoding = []

    def read(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        if not encoding:
            encoding.append(byte_bpe(ranks, pattern, special))
        out = []
        for conv in b.column("turns").to_pylist():
            ids = [np.append(encoding[0].encode_to_numpy(t["text"] or "", allowed_special="all"), end) for t in conv]
            mask = [np.full(len(i), t["role"] == "assistant") for i, t in zip(ids, conv, strict=True)]
            out.append((np.concatenate(ids).astype("<u4"), np.concatenate(mask)))
        return out

    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = whole.select(F.col("conv_id").alias("doc_id"), "turns")
    return pack(rows, limits, read, turns.schema["conv_id"].dataType.simpleString())

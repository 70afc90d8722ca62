"""Encoding of whole texts into the pieces of a sentencepiece BPE model, with the source bytes of every piece.

A text is normalised by the model's compiled character map, always by the longest prefix the map
knows, and each normalised character keeps the place it came from. The normalised text falls
into words that no piece crosses; the pieces of a distinct word are merged once and laid out
for all its occurrences, and their characters are projected back to bytes of the source.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from .common import ragged, slices

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.int64(1) << 40
#: Words of up to so many characters are merged side by side, longer ones each by itself.
WIDTHS = 0, 6, 10, 16, 32, 64
#: Characters of words that are merged side by side at once, and bytes of text encoded at once.
CELLS, SLICE_BYTES = 1 << 18, 2 << 20


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 prefixes, and the strings they become."""

    def __init__(self, compiled: bytes):
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.strings = compiled[4 + size :]
        self.trie = self.units.tolist()
        first = sorted(self._first_characters())
        self.candidates = regex.compile("[" + "".join(map(regex.escape, first)) + "]") if first else None

    def _step(self, node: int, byte: int) -> int | None:
        """The node below ``node`` along ``byte``."""
        unit = self.trie[node]
        to = node ^ (unit >> 10 << (unit >> 6 & 8)) ^ byte
        return to if self.trie[to] & 0x800000FF == byte else None

    def _first_characters(self) -> Iterator[str]:
        """Characters with which some prefix of the map begins."""
        if not self.trie:
            return
        reached = [(0, b"")]
        while reached:
            node, sofar = reached.pop()
            for byte in range(1, 256):
                to = self._step(node, byte)
                if to is None:
                    continue
                try:
                    yield (sofar + bytes([byte])).decode()
                except UnicodeDecodeError:
                    if len(sofar) < 3:
                        reached.append((to, sofar + bytes([byte])))

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest prefix of raw[at:] in the map, and what it becomes."""
        node, found = 0, None
        for i in range(at, len(raw)):
            to = self._step(node, raw[i])
            if to is None:
                break
            node = to
            unit = self.trie[node]
            if unit >> 8 & 1:
                value = self.trie[node ^ (unit >> 10 << (unit >> 6 & 8))] & 0x7FFFFFFF
                found = i + 1 - at, value
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])].decode()

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The mapped text and, for each of its characters and its end, a byte offset of ``text``."""
        raw = text.encode()
        starts = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
        if self.candidates is None:
            return text, starts
        out, origin, done = [], [], 0  # ``done`` characters of the text are mapped
        for m in self.candidates.finditer(text):
            if m.start() < done:
                continue
            rule = self.longest(raw, int(starts[m.start()]))
            if rule is None:
                continue
            size, becomes = rule
            out += [text[done : m.start()], becomes]
            origin += [starts[done : m.start()], np.full(len(becomes), starts[m.start()])]
            done = int(np.searchsorted(starts, starts[m.start()] + size))
        out.append(text[done:])
        origin.append(starts[done:])
        return "".join(out), np.concatenate(origin)


class Model:
    """What encoding needs of a model file: character map, flags, pieces with their scores."""

    @classmethod
    @cache
    def of(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def __init__(self, proto: bytes):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or train.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with escaped white space in front of words are read here")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not read here")
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self._symbols([(p.piece, p.score, i) for i, p in enumerate(spec.pieces) if p.type == NORMAL], len(spec.pieces))
        self.bytes = [i for i, p in enumerate(spec.pieces) if p.type == BYTE] if train.byte_fallback else []
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == train.eos_piece)
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces if p.type == NORMAL)
        self.words = regex.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", regex.DOTALL)

    def _symbols(self, pieces: list[tuple[str, float, int]], n_pieces: int) -> None:
        """Numbers of single characters, and which pairs of symbols become which piece. Symbols are pieces
        and the characters that occur in pieces without being one."""
        number = {p: i for p, _, i in pieces}
        for c in sorted({c for p, _, _ in pieces for c in p} - set(number)):
            number[c] = n_pieces + len(number) - len(pieces)
        self.n_pieces, self.n_symbols = n_pieces, n_pieces + len(number) - len(pieces) + 1
        self.character = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        rank = {x: r for r, x in enumerate(sorted({-x for _, x, _ in pieces}))}
        self.merges = {}
        for p, score, i in pieces:
            for cut in range(1, len(p)):
                if p[:cut] in number and p[cut:] in number:
                    self.merges[number[p[:cut]], number[p[cut:]]] = rank[-score], i
        pairs = sorted((a * self.n_symbols + b, r, i) for (a, b), (r, i) in self.merges.items())
        self.pair, self.pair_rank, self.pair_becomes = (np.array(x) for x in zip(*(pairs or [(-1, NEVER, 0)])))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text as pieces see it, and the source byte at which each character (and the end) begins."""
        if not text:
            return "", np.zeros(1, np.int64)
        plain, origin = self.map.apply(text)
        norm = plain.replace(" ", SPACE)
        if self.squeeze:
            # Only spaces are squeezed: a mark of the source that looks like an escaped space is none.
            blank = np.array([c == " " for c in plain] + [False])
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            kept = np.flatnonzero(keep[:-1])
            if not len(kept):
                return "", origin[-1:]
            norm, origin = "".join(norm[i] for i in kept), origin[np.append(kept, len(plain))]
            if norm.endswith(SPACE):
                cut = len(norm.rstrip(SPACE))
                norm, origin = norm[:cut], origin[: cut + 1]
        if self.prefix and norm:
            norm, origin = SPACE + norm, np.concatenate([origin[:1], origin])
        return norm, origin

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces per word, their ids, the characters that each covers). A character without a piece is
        spelled in bytes, of which the last covers it, or is unknown, neighbours together."""
        size = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = self.character[chars]
        begins = np.ones(len(chars), bool)  # whether a symbol begins at the character
        start = np.cumsum(size) - size
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            some = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(some, len(some) * high // CELLS + 1):
                self._merge_rows(sym, begins, start[part], size[part], high)
        for i in np.flatnonzero(size > WIDTHS[-1]).tolist():
            self._merge_long(sym[start[i] : start[i] + size[i]], begins[start[i] : start[i] + size[i]])
        at = np.flatnonzero(begins)
        covers, ids = np.diff(at, append=len(chars)), sym[at]
        word = np.repeat(np.arange(len(words)), size)[at]
        odd = np.flatnonzero((ids < 0) | (ids >= self.n_pieces))
        if self.bytes and len(odd):
            spelled = [chr(c).encode() for c in chars[at[odd]].tolist()]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(x) for x in spelled]
            last = np.cumsum(n) - 1
            ids, covers, word = np.repeat(ids, n), np.zeros(last[-1] + 1, np.int64), np.repeat(word, n)
            covers[last] = np.diff(at, append=len(chars))
            ids[ragged(last[odd] - n[odd] + 1, n[odd])] = [self.bytes[b] for x in spelled for b in x]
        elif len(odd):
            ids[odd] = self.unknown
            again = np.flatnonzero((ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (word[1:] == word[:-1])) + 1
            first = np.delete(np.arange(len(ids)), again)
            covers, ids, word = np.add.reduceat(covers, first), ids[first], word[first]
        return np.bincount(word, minlength=len(words)).astype(np.int64), ids, covers

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair (NEVER: it does not merge) and the symbol that it becomes."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        good = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.pair_rank[at], NEVER), self.pair_becomes[at]

    def _merge_rows(self, sym: np.ndarray, begins: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> None:
        """Merge words of at most ``width`` characters side by side, one pair of each word a round: the
        best ranked, of equal ones the leftmost. Column ``width`` stands for the end of a word."""
        if not len(start):
            return
        n, column = len(start), np.arange(width)
        there = column < size[:, None]
        s = np.full((n, width + 1), -1, np.int32)
        s[:, :width][there] = sym[ragged(start, size)]
        after = np.where(column + 1 < size[:, None], column + 1, width).astype(np.int16)
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        rank, becomes = self._look_up(s[:, :-1], np.where(after < width, s[:, 1:], -1))
        alive, row = there.copy(), np.arange(n)
        while len(row):
            j = rank[row].argmin(1)
            on = rank[row, j] < NEVER
            row, j = row[on], j[on]
            k = after[row, j]
            m = after[row, k]
            s[row, j], alive[row, k], rank[row, k] = becomes[row, j], False, NEVER
            after[row, j], before[row, m] = m, j
            rank[row, j], becomes[row, j] = self._look_up(s[row, j], s[row, m])
            r, p = row[before[row, j] >= 0], before[row, j][before[row, j] >= 0]
            rank[r, p], becomes[r, p] = self._look_up(s[r, p], s[r, after[r, p]])
        flat = ragged(start, size)
        sym[flat], begins[flat] = s[:, :width][there], alive[there]

    def _merge_long(self, sym: np.ndarray, begins: np.ndarray) -> None:
        """The same for one long word, by a heap of its pairs."""
        n, s = len(sym), sym.tolist()
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the symbol at i ends before stop[i]
        rank, becomes = (x.tolist() for x in self._look_up(sym[:-1], sym[1:]))
        agenda = [(r, i, i + 1, i + 2, to) for i, (r, to) in enumerate(zip(rank, becomes)) if r < NEVER]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, end, to = heapq.heappop(agenda)
            if stop[i] != j or stop[j] != end:  # one of the two has changed since
                continue
            s[i], stop[i], stop[j], begins[j] = to, end, -1, False
            if end < n:
                before[end] = i
            for a in (i, before[i]):
                b = stop[a] if a >= 0 else n
                if b < n and (found := self.merges.get((s[a], s[b]))):
                    heapq.heappush(agenda, (found[0], a, b, stop[b], found[1]))
        sym[:] = s

    def encode(self, texts: pa.Array, add_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per text, ids, first and last source byte of each) of all texts."""
        words, per_text, origins = [], [], []
        for text in texts.to_pylist():
            norm, origin = self.normalise(text)
            found = self.words.findall(norm)
            words += found
            per_text.append(len(found))
            origins.append(origin)
        coded = pa.array(words, pa.string()).dictionary_encode()
        del words
        size, flat_ids, flat_sizes = self.spell(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        take = ragged((np.cumsum(size) - size)[code], size[code])
        ids, chars = flat_ids[take], flat_sizes[take]
        per_text = np.array(per_text, np.int64)
        of = np.repeat(np.repeat(np.arange(len(per_text)), per_text), size[code])
        n = np.bincount(of, minlength=len(per_text)).astype(np.int64)
        # Origins of a text lie one after another, with one more for its end.
        before = np.cumsum([0] + [len(o) for o in origins])[:-1]
        upto = np.cumsum(chars)
        reached = np.concatenate([[0], upto])[np.cumsum(n) - n]  # characters in the texts before
        last = upto - np.repeat(reached, n) + np.repeat(before, n)
        origin = np.concatenate(origins) if origins else np.zeros(0, np.int64)
        start, stop = origin[last - chars], origin[last]
        if add_end:
            at = np.cumsum(n)
            close = origin[before + np.array([len(o) - 1 for o in origins], np.int64)] if origins else origin
            ids, start, stop = np.insert(ids, at, self.end), np.insert(start, at, close), np.insert(stop, at, close)
            n = n + 1
        return n, ids, start, stop


def encode(docs: DataFrame, path: str, add_end: bool = True, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of every whole text under the sentencepiece model at ``path``, without sampling.

    Reads two columns. Returns doc_id, ids, starts and ends (arrays of equal length): piece i stands for
    the bytes starts[i] to ends[i] (exclusive) of the text's UTF-8. Of a character spelled in bytes
    the last byte has the span and the ones before are empty; so is the end id, last if ``add_end``. A
    null or empty text has no other id. Rows are independent: null ids and repeated rows are
    returned each, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                n, *columns = model.encode(part.column("text"), add_end)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "ids", "starts", "ends"])
                pa.default_memory_pool().release_unused()  # workers are kept, what they once needed should not be

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text that the model at ``path`` makes of the array
    ``ids``. A null array gives null, an empty one an empty text; an id that the model
    does not have is an error."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentencePieceProcessor(model_file=path)
        for b in batches:
            for part in slices(b, "ids", 1 << 18):
                ids = part.column("ids")
                texts = iter(model.decode(ids.drop_null().to_pylist(), num_threads=1) if ids.null_count < len(ids) else [])
                made = pa.array([next(texts) if there else None for there in pc.is_valid(ids).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))

"""Periodic runs of words: stretches that repeat with some period, each as long as it can be.

The first phase of Baier's suffix sorter gathers suffixes into groups by their longest Lyndon
prefix, so its group lengths are the Lyndon array. Run under an order of the words and under its
reverse it gives, for every run, a position where the run's root is a longest Lyndon word (a Lyndon
root). Roots are extended to both sides as far as words one period apart agree.

All of this is per text; texts share a pass of the grouping, with a smallest mark between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices


def lyndon_array(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position of ``rank`` (0 marks the ends of texts and is
    smaller than all; the lengths at marks mean nothing).

    Groups are taken from the largest down. The suffixes of a group are final; each is taken out
    of the row of open suffixes, and the nearest open one before it has the group's word, as often
    as it was named, at the end of its own: such suffixes move to a new group right above theirs.
    """
    n = len(rank)
    before, after = list(range(-1, n)), [*range(1, n + 1), 0]  # neighbours among open suffixes; -1 and n: none
    values, group = np.unique(rank, return_inverse=True)
    members = [x.tolist() for x in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])]
    group, length = group.tolist(), [1] * len(values)
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    below.append(len(values) - 1)  # the last place stands for what is above all groups
    above.append(-1)
    length.append(0)
    members.append([])
    out = np.ones(n, np.int64)
    now, marks = len(values) - 1, 0 if len(values) and values[0] == 0 else -1
    while now > marks:
        mine = [i for i in members[now] if group[i] == now]
        members[now] = ()
        named: dict[int, int] = {}
        for i in mine:  # ascending: the members before it are out already
            p, a = before[i], after[i]
            after[p], before[a] = a, p
            named[p] = named.get(p, 0) + 1
        named.pop(-1, None)
        size = length[now]
        out[mine] = size
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in named.items():
            if group[p] != marks:
                moved.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moved, reverse=True):  # the often named come to lie higher
            new, some = len(members), moved[times, old]
            members.append(some)
            length.append(length[old] + times * size)
            below.append(old)
            above.append(above[old])
            below[above[old]] = above[old] = new
            for p in some:
                group[p] = new
        now = below[now]
    return out


class Blocks:
    """Names of the blocks of 1, 2, 4, ... values at each position, equal for equal blocks, to compare
    stretches exactly in a logarithmic number of steps."""

    def __init__(self, rank: np.ndarray, longest: int):
        self.n, self.names = len(rank), [rank]
        while 1 << len(self.names) <= longest:
            half, last = 1 << (len(self.names) - 1), self.names[-1]
            pair = last[:-half] * (int(last.max(initial=0)) + 1) + last[half:]
            self.names.append(np.unique(pair, return_inverse=True)[1] if len(pair) else pair)

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many values from positions ``i`` and ``j`` on are equal; ``back``: before them."""
        done = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            names, step = self.names[k], 1 << k
            a, b = (i - done - step, j - done - step) if back else (i + done, j + done)
            fits = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
            same = np.zeros(len(i), bool)
            same[fits] = names[a[fits]] == names[b[fits]]
            done += same * step
        return done


def find(rank: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs with at least so many words and periods, by start and period.
    ``rank`` holds numbers of words from 1 on, and a 0 after each text."""
    if not len(rank):
        return (np.zeros(0, np.int64),) * 3
    text = np.cumsum(rank == 0)
    longest = int(np.diff(np.flatnonzero(rank == 0), prepend=-1).max())
    blocks, found = Blocks(rank, longest), []
    for order in (rank, np.where(rank == 0, 0, rank.max() + 1 - rank)):
        period = lyndon_array(order)
        i = np.flatnonzero(rank > 0)
        i = i[i + period[i] < len(rank)]
        i = i[(rank[i] == rank[i + period[i]]) & (text[i] == text[i + period[i]])]
        p = period[i]
        start = i - blocks.agree(i, i + p, back=True)
        length = i + p + blocks.agree(i, i + p) - start
        keep = length >= np.maximum(min_length, min_exponent * p)
        found.append(np.stack([start[keep], p[keep], length[keep]]))
    start, p, length = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, length, p


def possible(word: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Positions that some run can hold: within a stretch of such positions, at least ``min_length`` long,
    each word of a run occurs at least ``min_exponent`` times. What is left out is in no run."""
    at = np.arange(len(word))
    for _ in range(16):  # each turn is exact; runs are found by ``find``, which needs no further turn
        if not len(at):
            break
        stretch = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(text[at], prepend=-1) != 0)) - 1
        long = np.bincount(stretch)[stretch] >= min_length
        at, stretch = at[long], stretch[long]
        _, which, times = np.unique(stretch * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        often = times[which] >= min_exponent
        if long.all() and often.all():
            break
        at = at[often]
    return at


def runs_of(texts: list[bytes], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(runs per text, start, length, period of each, the texts without repeated periods)."""
    words = [t.split() for t in texts]  # bytes are cut at exactly the ASCII white space
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text = np.repeat(np.arange(len(texts)), size)
    at = possible(word, text, min_length, min_exponent)
    # Stretches of possible positions one after another, with a mark behind each.
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(text[at]) != 0)) + 1
    ends = np.append(breaks, len(at)) if len(at) else breaks
    start, length, period = find(np.insert(word[at], ends, 0), min_length, min_exponent)
    start = at[start - np.searchsorted(ends + np.arange(len(ends)), start)]
    of = text[start]
    drop = np.zeros(len(word) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    collapsed = []
    touched = set(of.tolist())
    for i, w in enumerate(words):
        if i in touched:
            w = [x for x, k in zip(w, keep[first[i] : first[i] + size[i]].tolist()) if k]
        collapsed.append(b" ".join(w))
    return np.bincount(of, minlength=len(texts)), start - first[of], length, period, collapsed


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Runs in the words (by ASCII white space) of every whole text.

    Reads two columns. Returns doc_id, runs (array of start, length and period in words, by start, then
    period) and collapsed, the text's words joined by single spaces without those that a run holds
    after its first period. A run is a longest stretch with a smallest period of at least ``min_length``
    words and ``min_exponent`` (2 or more) periods. Null and empty texts have no words and an empty
    collapsed text. Rows are independent: null ids and repeated rows are returned each, an empty
    table gives an empty result.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                n, start, length, period, collapsed = runs_of(part.column("text").to_pylist(), min_length, min_exponent)
                columns = [pa.array(x.astype(np.int32)) for x in (start, length, period)]
                each = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), each)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:int,length:int,period:int>>, collapsed string")

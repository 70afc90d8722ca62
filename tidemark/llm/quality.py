"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
    "distinct_lines", "words_a_line", "upper", "lower", "digit", "space", "stop_comma", "marks", "symbols", "controls",
    "other_bytes", "byte_entropy", "marked_word_ends", "capital_words", "vowels", "one_letter_words",
)
#: The sample that the trees are fitted to holds at most so many labelled documents.
SAMPLE = 20_000
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c", "stop_comma": b".,", "marks": b"!?;:'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{|}~",
}
_TABLE = np.zeros((256, len(_CLASSES) + 2))
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
_TABLE[128:, -1] = 1
_TABLE[:, -2] = _TABLE.sum(axis=1) == 0
_MARKED = re.compile(rb"[!?#$%&*+/<=>@^_|~]$")


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of FEATURES; shares of nothing are 0."""
    n = len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = len(words)
    if not w:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    seen = Counter(words)
    sizes = list(map(len, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    bins = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = bins @ _TABLE / n
    p = bins[bins > 0] / n
    vowels = bins[list(b"aeiouAEIOU")].sum() / max(bins[65:123].sum(), 1)
    return [
        float(np.log1p(n)), float(np.log1p(w)), sum(sizes) / w, float(np.log1p(max(sizes))), len(seen) / w, max(seen.values()) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, pairs / max(w - 1, 1), len(set(lines)) / len(lines), float(np.log1p(w / len(lines))),
        *map(float, shares), float(-(p * np.log2(p)).sum()), sum(c for x, c in seen.items() if _MARKED.search(x)) / w,
        sum(c for x, c in seen.items() if x[:1].isupper()) / w, float(vowels), sizes.count(1) / w,
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees of one depth in flat arrays: node i of a tree has children 2i+1, 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner, rows = self.feature.shape[1], np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0) -> Trees:
    """Boost trees on the log loss. Features are cut into quantile bins once; a node's split is the
    best gain over sums of gradients by bin. Without rows the score is 1/2, with rows of one
    class it is near that class."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    p0 = (y.sum() + 0.5) / (n + 1)
    model = Trees(float(np.log(p0 / (1 - p0))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    flat = binned + bins * np.arange(m)
    margin, grown = np.full(n, model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (m * bins) + flat).ravel()
            g = np.bincount(where, np.repeat(grad, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            h = np.bincount(where, np.repeat(hess, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            tg, th = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + smooth) + (tg - g) ** 2 / (th - h + smooth) - tg**2 / (th + smooth)
            gain[(h < 1) | (th - h < 1)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-6):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + smooth)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(a) for a in zip(*grown, strict=True))
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE) -> Trees:
    """Fit on labelled documents whose crc32(doc_id) mod ``modulus`` isn't ``held``.

    Of those at most ``sample`` are used, the ones with the smallest hash of the id; their
    features, a few MB, are all that reaches the driver. Several labels of a document are
    averaged (1 from one half on); null labels and labels of other documents are ignored.
    """
    usable = labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), modulus) != held) & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    picked = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.string()), b.column("y"), pa.array(list(_matrix(b)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
            )

    got = rows.mapInArrow(run, "doc_id string, y int, x array<double>").orderBy("doc_id", "x").collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every document; null and empty texts are scored by their zero statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) for every document.

    Only the text enters a score. Repeated rows are returned each; without usable labels all
    scores are 1/2; an empty table gives an empty result."""
    model = train(docs, labels, modulus, held)
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """``docs``, all columns, without those predicted to be of low quality. The rows are filtered
    where they lie; nothing is joined."""
    model = train(docs, labels, modulus, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)

"""Token counts of documents from the piece counts of their distinct pre-tokens."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import blocks

#: Unicode White_Space, as the tokenizer's normaliser and pattern understand it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PreTokenizer:
    """Cuts a text the way a tokenizer file of this kind does, before any merge.

    Such a file normalises with NFC, white-space runs to one space and lower case, then cuts by a
    pattern that drops white space. Special strings are found in the raw text first and stand
    for one id each.
    """

    @classmethod
    @cache
    def of(cls, path: str) -> PreTokenizer:
        return cls(path)

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        cuts = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if steps != ["NFC", "Replace", "Lowercase"] or len(cuts) != 1 or not cuts[0]["invert"]:
            raise ValueError(f"{path} does not normalise or cut as this reader expects")
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"), regex.V0)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.pattern.findall(lowered(text))
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += self.pattern.findall(lowered(text[last : m.start()]))
            out.append(m.group())
            last = m.end()
        return out + self.pattern.findall(lowered(text[last:]))


def lowered(text: str) -> str:
    """NFC, then each character's lower case on its own (a final sigma is not special)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def piece_counts(terms: DataFrame, path: str) -> DataFrame:
    """(block, packed) of (block, pos, term) rows: positions and pieces of neighbouring rows of a block,
    packed. All rows of a term meet in one task, which counts its pieces once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = Tokenizer.from_file(path), {}
        for b in batches:
            words = b.column("term").to_pylist()
            new = list({w for w in words if w not in known})
            for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[w] = len(e.ids)
            pieces = np.array([known[w] for w in words], np.int32)
            block, packed = blocks.pack(b.column("block").to_numpy(), b.column("pos").to_numpy(), pieces)
            yield pa.RecordBatch.from_arrays([pa.array(block), packed], names=["block", "packed"])

    return terms.select("block", "pos", "term").repartition("term").mapInArrow(run, "block long, packed binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text under the tokenizer file ``path``, without making ids.

    Reads doc_id and text. Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens >
    ``limit``). A null or empty text has none of either; repeated rows are returned each; an
    empty table gives an empty result.
    """

    def tokenise(texts: pa.Array) -> pa.ListArray:
        cut = PreTokenizer.of(path)
        return pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    def finish(take, weight, n_bytes, n_terms):
        n = take("pieces").astype("int64")
        return {"n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit}

    def decode(rows: pa.Table) -> dict[str, np.ndarray]:
        return dict(zip(("pos", "pieces"), blocks.unpack(rows.column("packed"), 2)))

    made = blocks.encode(docs, tokenise)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = piece_counts(blocks.terms(made), path)
    return blocks.per_document(made, counted, finish, kind, "n_bytes long, n_tokens long, over_limit boolean", decode)

"""The template tree against a plain one, and templates of several fields at several sizes."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup

from .test_llm import prose


def plain_tree(texts, depth=3, min_docs=2, constant=0.75, share=0.5):
    """Positions of the lines of every text whose template recurs, or that recur as lines of numbers."""
    lines = defaultdict(set)  # (leaf, tokens): texts
    at = defaultdict(list)
    equal = defaultdict(set)
    for text in set(texts):
        for pos, raw in enumerate(text.split("\n")):
            words = raw.lower().split()
            toks = tuple("<*>" if any(c.isdigit() for c in w) else w for w in words)
            if toks:
                leaf = (len(toks), toks[:depth])
                lines[leaf, toks].add(text)
                at[text].append((pos, leaf, toks))
                if 2 * toks.count("<*>") > len(toks):
                    equal[tuple(words)].add(text)
    support = Counter()
    for (leaf, toks), of in lines.items():
        for p, t in enumerate(toks):
            support[leaf, p, t] += len(of)
    template, holders = {}, defaultdict(set)
    for (leaf, toks), of in lines.items():
        held = sorted((support[leaf, p, t] for p, t in enumerate(toks) if t != "<*>"), reverse=True)
        if not held:
            continue
        floor = max(min_docs, share * held[max(1, math.ceil(constant * len(held))) - 1])
        shape = tuple(t if t != "<*>" and support[leaf, p, t] >= floor else None for p, t in enumerate(toks))
        fixed = sum(t is not None for t in shape)
        if fixed >= constant * len(held) and 2 * fixed >= len(toks):
            template[leaf, toks] = (leaf, shape)
            holders[leaf, shape] |= of
    out = {}
    for text in set(texts):
        raw = text.split("\n")
        out[text] = {pos for pos, leaf, toks in at[text] if len(holders[template.get((leaf, toks))]) >= min_docs}
        out[text] |= {pos for pos, _, _ in at[text] if len(equal.get(tuple(raw[pos].lower().split()), ())) >= min_docs}
    return [out[t] for t in texts]


def test_lines_as_of_a_plain_tree(spark):
    rng = np.random.default_rng(5)
    word = lambda n: f"w{'abcdefghijklmnopqrstuvwxyz'[rng.integers(n)]}"
    def line():
        kind = rng.integers(5)
        if kind == 0:
            return f"Posted by {word(4)} in {word(26)} for all readers of the site"
        if kind == 1:
            return " ".join(f"{rng.integers(4)}" for _ in range(4)) + " Total"
        if kind == 2:
            return "  see the notes\t" + " ".join(word(2) for _ in range(6))
        return "" if kind == 3 else " ".join(word(3) for _ in range(rng.integers(1, 5)))
    texts = ["\n".join([*(line() for _ in range(4)), prose(60, i), prose(60, 500 + i)]) for i in range(120)]
    texts += texts[:5] + ["", " \n", "x"]
    got = sorted(line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=1.0).select("drop").collect())
    want = plain_tree(texts)
    assert sorted(sorted(r["drop"]) for r in got) == sorted(sorted(w) for w in dict(zip(texts, want, strict=True)).values() if w)


@pytest.mark.parametrize("count", [40, 400, 4000])
def test_two_fields_at_any_size(spark, count):
    texts = [f"{prose(30, i)}\narticle written by author x{chr(97 + i % 20)} and edited in city y{chr(97 + i // 20 % 20)} for our readers today" for i in range(count)]
    got = line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.n_dropped, r.text == texts[r.doc_id].split("\n")[0]) for r in got.collect()} == {(1, True)}


def test_copies_of_different_edits_stay_and_a_shared_passage_goes(spark):
    body = [prose(25, 100 + i) for i in range(10)]
    texts = ["\n".join(body)]
    for i in (2, 5, 8):  # a word more in one line
        texts.append("\n".join(b + " more" if k == i else b for k, b in enumerate(body)))
    texts += [f"{prose(20, 300 + i)}\n{prose(60, 400)}" for i in range(4)]  # mostly one passage, no copies
    texts.append("\n".join([*body, *(prose(25, 200 + i) for i in range(30))]))  # all of it and much more
    got = sorted(line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.left_whole for r in got] == [True] * 4 + [False] * 5
    assert [r.n_dropped for r in got] == [0] * 4 + [1] * 4 + [10]

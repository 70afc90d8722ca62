"""Collocations against counting all phrases of small texts."""

import re
from collections import Counter

import numpy as np

from tidemark.llm import collocations

RNG = np.random.default_rng(12)


def expected(rows, least, longest, percent=100, limit=2000):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    candidates = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    inside = {}
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, w[i : i + size]
                inside[key] = max(inside.get(key, 0), a)
    for (lang, w), a in candidates.items():
        if 100 * inside.get((lang, w), -1) >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]], n[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        for rank, x in enumerate(sorted(y for y in out if y[0] == lang)[:limit], 1):
            ranked.append((lang, rank, x[3].decode(), -x[2], x[4], x[5], x[6], -x[1]))
    return sorted(ranked)


def test_like_counting_all_phrases(spark):
    words = ["The", "of", "été", "x\x00", "Ω", "42", "a-b", "\x1c", "日本", "cat's"]
    join = lambda n: "".join(w + str(RNG.choice([" ", "  ", "\t", ", ", "\n", ".", "\r\n", " \x0b"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])) for w in RNG.choice(words, n))
    rows = [(join(int(RNG.integers(0, 60))), str(RNG.choice(["en", "de"]))) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), ("one two", None), ("one two", None), ("one two", "und"), (" . ; ", "xx"), ("k " * 3000, "en"), rows[0], rows[0]]
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, block long, n string")
    for least, longest, percent, limit in [(3, 5, 100, None), (2, 3, 80, 7), (5, 2, 100, 2000)]:
        got = collocations.collocations(docs, least, longest, percent, limit).collect()
        assert sorted(map(tuple, got)) == expected(rows, least, longest, percent, limit if limit else 10**9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, None)], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.where("false")).columns == ["group", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(docs.where("false")).collect() == []


def test_products_pass_64_bits(spark):
    a, n, l, r = 4_000_000_007, 9_000_000_000_000_011, 4_000_000_009, 5_000_000_021
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(collocations.score()).first()[0] == 1000 * a * n // (l * r)

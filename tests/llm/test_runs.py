"""Runs against a search of all periods, and Lyndon arrays against their definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import runs
from tidemark.llm.queries import QUERIES

RNG = np.random.default_rng(13)


def all_runs(w, min_length, min_exponent):
    out = []
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            smallest = not any(w[i : j + p - q] == w[i + q : j + p] for q in range(1, p))
            if length >= max(min_length, min_exponent * p) and smallest:
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings():
    for _ in range(400):
        n = int(RNG.integers(1, 45))
        w = RNG.integers(1, RNG.integers(2, 5), n)
        a, p = int(RNG.integers(0, n)), int(RNG.integers(1, 9))
        yield [int(w[i]) if i < a or RNG.random() < 0.01 else int(w[min(a + (i - a) % p, n - 1)]) for i in range(n)]


def test_lyndon_array_is_longest_lyndon_words():
    for w in strings():
        expected = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]
        assert runs.lyndon_array(np.array(w)).tolist() == expected
        assert runs.lyndon_array(np.array([*w, 0, *w, 0]))[: len(w)].tolist() == expected


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (1, 2), (5, 3)])
def test_all_runs_are_found(min_length, min_exponent):
    texts = list(strings())
    n, start, length, period, collapsed = runs.runs_of([b" ".join(b"%d" % x for x in w) for w in texts], min_length, min_exponent)
    got = iter(zip(start.tolist(), length.tolist(), period.tolist()))
    for w, k, c in zip(texts, n, collapsed):
        expected = all_runs(w, min_length, min_exponent)
        assert [next(got) for _ in range(k)] == expected
        dropped = {i for s, size, p in expected for i in range(s + p, s + size)}
        assert c.decode().split() == [str(x) for i, x in enumerate(w) if i not in dropped]


def test_nested_and_long_runs():
    w = ([1] * 5 + [2]) * 4 + [3, 4] * 30_000
    n, start, length, period, collapsed = runs.runs_of([b" ".join(b"%d" % x for x in w)], 5, 4)
    expected = [(6 * i, 5, 1) for i in range(4)] + [(0, 24, 6), (24, 60_000, 2)]
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == sorted(expected)


def test_odd_rows(spark):
    rows = [(0, None, 1), (1, "", 1), (2, " \t\n ", 1), (3, "a b " * 4, 1), (3, "a b " * 4, 2), (None, "é " * 6, 1), (4, "x y x y x y\x1cx", 1), (5, "A a " * 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    expected = [(0, [], ""), (1, [], ""), (2, [], ""), (3, [(0, 8, 2)], "a b"), (3, [(0, 8, 2)], "a b"), (None, [(0, 6, 1)], "é"), (4, [], rows[6][1]), (5, [], "A a A a A a")]
    assert got == expected
    assert runs.periodic_runs(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def test_query(spark):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = QUERIES["op13_runs"](spark, base).collect()
    assert len(got) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        elif n > 1500:
            continue  # the search of all periods is slow
        found = all_runs(w, 6, 4)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if found else None
        dropped = {i for s, size, q in found for i in range(s + q, s + size)}
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))

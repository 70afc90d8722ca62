"""Cases of the findings of round 3 on the corpus operators."""

import os
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import blocks, collocations, language_model, line_dedup, near_duplicates
from tidemark.session import shared_folder


def edited(text, edits, seed):
    rng, w = np.random.default_rng(seed), text.split()
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"edit{rng.integers(10**6)}"
    return " ".join(w)


def test_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with one or two edits, near the threshold: one group, by few more pairs than texts."""
    base = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 3000, 150))
    texts = [base, *(edited(base, 1 + i % 2, i) for i in range(600))]
    exact, asked = near_duplicates._similar, []

    def similar(docs, pairs, shingle, threshold):
        asked.append(pairs.count())
        return exact(docs, pairs, shingle, threshold)

    monkeypatch.setattr(near_duplicates, "_similar", similar)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_duplicates.similar(df).select("root").distinct().count() == 1
    assert sum(asked) <= 6 * len(texts)


def test_lines_are_masked_once_and_texts_hashed_once(spark):
    """Blank lines go and tokens are cut at any white space, without a second pass over the tokens."""
    text = "One  two\tthree 42\n \t\x0b\n\n\x0cfour\x0b7 7 a\r\n  five 5 5 5"
    df = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, text)], "doc_id long, text string")
    lines = line_dedup.lines_of(df, 3)
    got = sorted((r.pos, r.n, r.exact is not None, r.body) for r in lines.collect())
    one = [(0, 4, False, "one  two\tthree <*>"), (3, 4, False, "\x0cfour\x0b<*> <*> a\r"), (4, 4, True, "  five <*> <*> <*>")]
    assert got == sorted(one * 2)
    assert len({(r.leaf, r.line) for r in lines.where("pos = 0").collect()}) == 1
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert plan.index("xxhash64(text") > plan.index("Generate")


def test_phrases_are_numbered_by_frequency():
    """The same occurrences in fewer bytes than numbers by first appearance at the codec's lowest level take."""
    rng = np.random.default_rng(3)
    words = [f"w{min(int(x), 60_000)}" for x in rng.zipf(1.2, 200_000)]
    made = collocations._occurrences([" ".join(words[:100_000]).encode(), " ".join(words[100_000:]).encode()])
    packed = made["phrase"][0].as_py()
    phrase, names = blocks.from_planes(packed), made["word"][0].as_py()
    assert [names[x] for x in phrase] == words
    assert made["times"][0].as_py() == sorted(np.bincount(phrase).tolist(), reverse=True)
    first: dict[str, int] = {}
    before = np.array([first.setdefault(w, len(first)) for w in words], "<i4")
    assert len(packed) < 0.97 * len(pa.compress(before.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True))


def test_language_model_deals_terms_packed_and_deletes_what_is_read_no_more(spark, monkeypatch):
    """A row a block and part instead of one a term; any parts and blocks give the same scores; no terms are left on disk."""
    texts = [f"{'river stone Water ' * (i % 5)}w{i % 37} x{i} {'' if i % 3 else 'the end'}" for i in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = blocks.encode(df, language_model.tokens, term_type="binary")
    dealt = language_model.dealt_terms(made, 7).orderBy("part", "block").toArrow()
    values, count = language_model._texts(dealt)
    got = sorted(zip(np.repeat(dealt.column("block").to_numpy(), count).tolist(), np.concatenate([np.cumsum(blocks.from_planes(x)) for x in dealt.column("pos").to_pylist()]).tolist(), values.to_pylist()))
    assert got == sorted((r.block, r.pos, bytes(r.term)) for r in blocks.terms(made).collect())
    assert all(zlib.crc32(t) % 7 == p for t, p in zip(values.to_pylist(), np.repeat(dealt.column("part").to_numpy(), count)))
    assert dealt.num_rows <= 7 * made.count()

    folder = f"{shared_folder(spark)}/tables"
    before = set(os.listdir(folder))
    want = sorted(language_model.score(df).collect())
    assert not any({"terms", "gram"} & set(spark.read.parquet(f"{folder}/{t}").columns) for t in set(os.listdir(folder)) - before)
    for refs, parts, least in ((50, 120, 1), (100_000, 100_000, 1), (3, 7, 40)):
        monkeypatch.setattr(language_model, "TERM_REFS", refs)
        monkeypatch.setattr(language_model, "PART_REFS", parts)
        monkeypatch.setattr(language_model, "LEAST_PARTS", least)
        found = sorted(language_model.score(df).collect())
        assert [r[:5] for r in found] == [r[:5] for r in want]
        assert np.allclose([r[5:7] for r in found], [r[5:7] for r in want], rtol=1e-5)


def test_lines_shared_by_texts_are_found_by_one_aggregate(spark):
    """Copies of one text are one text; two texts are told from the extremes of their keys, three are counted."""
    keys = [("a", 1, 5), ("a", 1, 5), ("b", 1, 5), ("b", 1, 6), ("c", 1, 5), ("c", 2, 5), ("c", 3, 5)]
    df = spark.createDataFrame(keys, "leaf string, k1 long, k2 long")
    two = line_dedup.shared(df, ["leaf"], 2)
    assert [sorted(r.leaf for r in line_dedup.shared(df, ["leaf"], n).collect()) for n in (1, 2, 3)] == [["a", "b", "c"], ["b", "c"], ["c"]]
    assert two._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_words_of_a_text_do_not_grow_with_its_copies(spark):
    """Half of the words recurring is not mostly, however often the text is there; three quarters are."""
    head, tail = "one two three four five six", "seven eight nine ten eleven twelve"
    texts = [f"{head}\n\n{tail} a b c d e f g"] * 3 + [f"{head}\n{tail}"] * 2 + [f"{head}\nother words that nobody else has got"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.lines_of(df, 3).select("filled").collect()
    assert len(lines) == 12 and all(r.filled == 2 for r in lines)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.left_whole) for r in line_dedup.report(df).collect()}
    assert len({got[0], got[1], got[2]}) == 1 and got[0] == (2, 1, False) and got[5] == (2, 1, False) and got[3] == got[4] == (2, 1, False)


import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import embeddings, language_model, line_dedup, near_duplicates

from .test_llm import prose, union_find


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def edited(text, edits, seed):
    rng, w = np.random.default_rng(seed), text.split()
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"edit{rng.integers(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Texts with copies of 1 to 6 edits (similarity 0.97 to 0.75), chains of edits, a shared passage, short ones."""
    base = [" ".join(f"w{x}" for x in np.random.default_rng(s).integers(0, 3000, 150)) for s in range(40)]
    texts = [*base, *(edited(t, e, 10 * i + e) for i, t in enumerate(base) for e in range(1, 7))]
    for i in range(3):
        for k in range(8):
            texts.append(edited(base[i] if k == 0 else texts[-1], 3, 7000 + 10 * i + k))
    passage = prose(80, 77)
    texts += [passage + " " + prose(20, 9000 + i) for i in range(30)] + ["", "a b", "a  B", "a b c d e", "a b c d e f", prose(9, 1)]
    return texts


@pytest.mark.parametrize("often", [8, 1])
def test_stage_finds_all_edited_copies(spark, copies, monkeypatch, often):
    import corpus_pipeline

    monkeypatch.setattr(near_duplicates, "OFTEN", often)
    sets = [shingles(t) for t in copies]
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = union_find(alike, range(len(copies)))
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_line_dedup_pairs_mixtures_and_numbers(spark):
    line = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)) for i in range(40)]
    texts = [
        "\n".join([line[0], line[1], line[2]]), "\n".join([line[3], line[0], line[4]]),  # one line in two texts
        *("\n".join([line[5 + i], line[12], line[13 + i]]) for i in range(3)),
        "\n".join([line[5], line[6], line[7], line[20]]),  # mostly lines of three others, no copy of any
        "\n".join([line[21], "1 2 3 4", line[22]]), "\n".join([line[23], "1 2  3 4", line[24]]), "\n".join([line[25], "1 2 3 5", line[26]]),
        "\n".join(line[27:37]), "\n".join([*line[27:36], line[36][:-4] + "zzzz"]),  # copies
    ]
    got = sorted(line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.n_dropped for r in got] == [1, 1, 2, 2, 2, 3, 1, 1, 0, 0, 0]
    assert [r.left_whole for r in got] == [False] * 9 + [True] * 2
    assert got[5].text == line[20]


def near(x, cosine, rng):
    """A vector of that cosine to x."""
    y = rng.standard_normal(len(x))
    x = x / np.linalg.norm(x)
    y -= (x @ y) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def equals_brute_force(spark, x, threshold, **how):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    root = union_find([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)), strict=True)], range(len(x)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, threshold, **how).collect()}
    assert got == {i: (s[i].sum(), root[i]) for i in range(len(x))}
    return len(set(root.values()))


def test_embeddings_links_between_full_lists(spark):
    rng = np.random.default_rng(3)
    x = []
    for _ in range(4):
        a = rng.standard_normal(32)
        b = near(a, 0.915, rng)
        x += [near(c, 0.995, rng) for c in (a, b) for _ in range(14)]
    assert equals_brute_force(spark, np.array(x), 0.9) == 4


def test_embeddings_small_pairs_beside_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 2)
    rng = np.random.default_rng(4)
    x = [near(rng.standard_normal(48) if i == 0 else np.ones(48), 0.97, rng) for i in range(300)]
    for _ in range(60):
        a = rng.standard_normal(48)
        x += [a, near(a, 0.72, rng)]
    equals_brute_force(spark, np.array(x), 0.7, recall=1.0)  # the audit sees all 420 vectors


def test_language_model_contexts_are_whole():
    """Every byte's context: the last six bytes, of the word before two at most."""
    words, want = [b"river", b"abcdefgh", b"xyz"], set()
    for i, word in enumerate(words):
        before = (words[i - 1][-language_model.TAIL :] if i else b"") + b" "
        stream = before + word + b" "
        for at in range(len(before), len(stream)):
            want.add(int.from_bytes(stream[max(0, at - language_model.DEPTH) : at + 1], "big"))
    terms = language_model.tokens(pa.array([b" ".join(words).decode()])).flatten()
    got = set(language_model.grams(terms).flatten().to_pylist())
    assert {g for g in got if g & 255 != 10} == want

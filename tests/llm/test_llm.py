"""The corpus operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tidemark.llm import (
    blocks, components, decontamination, embeddings, language_model, line_dedup, near_duplicates, packing, quality, sharding, token_counts, url_filters,
)
from tidemark.llm.queries import QUERIES, SQL, byte_bpe

RNG = np.random.default_rng(5)
VOCABULARY = ["the", "of", "river", "stone", "Größe", "niño", "cat's", "42", "walks", "over", "under", "blue", "x1", "été", "HTTP", "Σίσυφος", "日本", "a"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


LONG = prose(30_000, 1)
TEXTS = [None, "", "  \n\t ", "one", "Two words", prose(50, 2), prose(50, 2), prose(50, 2) + " end", LONG, LONG, "a<|endoftext|>b <|startoftext|> c",
         "ΟΔΟΣ İstanbul e\u0301te\u0301\u0085x\u00a0y \x1c z", "tab\there\nnew  line", *[prose(40, s) for s in range(10, 40)]]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with a null id, a repeated row, and columns whose names the operators use inside."""
    rows = [(i, t, "x", i * 1.5, [1], f"s{i % 3}", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here", "x", 0.0, [2], None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, size double, terms array<int>, source string, n_chars long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(SQL) <= set(QUERIES)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 130)] + [(7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 130))]


def test_token_counts(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for r in rows(token_counts.count_tokens(docs, path)):
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(docs, path).count() == len(TEXTS) + 2
    assert token_counts.count_tokens(none, path).count() == 0


def test_quality_trees_and_edges(spark, docs, none):
    x = RNG.standard_normal((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    assert (quality.fit(x[:0], y[:0]).score(x[:5]) == 0.5).all()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(3, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(docs, labels))
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    relabelled = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert got == rows(quality.classify(docs, relabelled))  # held-out labels are not looked at
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.keep(docs, labels.where("false")).columns == docs.columns


def test_embeddings(spark):
    base = RNG.standard_normal((40, 16))
    vectors = [b + 0.12 * RNG.standard_normal(16) for b in base for _ in range(12)] + [*RNG.standard_normal((120, 16))]
    vectors = [list(map(float, v)) for v in vectors]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    data = [(i, v, 1, 2) for i, v in enumerate(vectors + [vectors[0]] * 5 + [[1e-30 * x for x in vectors[1]]] + bad)] + [(None, vectors[3], 1, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, v int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(data)
    good = [(i, np.array(v) / np.abs(v).max()) for i, v, _, _ in data if i is not None and i < len(data) - 1 - len(bad)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    root = union_find([(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)], range(len(good)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (s[i].sum(), root[i], root[i] == i) for i in range(len(good)))
    assert all((r.n_links, r.component_id) == (0, i) for i, r in got.items() if i is None or i >= len(good))
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def packed(df, ids_of):
    got = df.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = ids_of[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for pieces in by_sequence.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
    return by_doc, by_sequence


def test_packing_documents(docs, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate(TEXTS)) | {None: "no id here"}
    ids_of = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = packed(packing.pack_documents(docs, *byte_bpe()), ids_of)
    for i, ids in ids_of.items():
        times = 2 if i == 5 else 1
        assert Counter(p for s, n in by_doc[i] for p in range(s, s + n)) == Counter({p: times for p in range(len(ids))})
    fills = [sum(n for _, n, _ in p) for p in by_sequence.values()]
    assert all(f <= 1024 and f & (f - 1) == 0 for f in fills)
    assert packing.pack_documents(none, *byte_bpe()).count() == 0


def test_packing_limits():
    sizes, limits = RNG.integers(1, 60, 900), packing.Limits(64, 5, 40, 6)
    loss = [np.concatenate([[0], np.cumsum(RNG.random(n) < 0.5)]) for n in sizes]
    packer = packing.Packer(limits, lambda e, s, n: int(loss[e][s + n] - loss[e][s]))
    for e, n in enumerate(sizes):
        packer.add(e, int(n))
    packer.finish()
    used = Counter((e, p) for s in packer.done for e, a, n in s for p in range(a, a + n))
    assert used == Counter((e, p) for e, n in enumerate(sizes) for p in range(n))
    for s in packer.done:
        total = sum(n for _, _, n in s)
        assert total & (total - 1) == 0 and total <= 64 and len(s) <= 5 and sum(loss[e][a + n] - loss[e][a] for e, a, n in s) <= 40


def test_packing_conversations(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], None if c == 3 and t == 0 else prose(20 + c, c * 10 + t)) for c in range(20) for t in range(4)]
    got = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), *byte_bpe()).collect()
    assert {r.doc_id for r in got} == set(range(20)) and sum(r.loss_tokens for r in got) < sum(r.length for r in got)


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash(docs, none, shingle):
    got = near_duplicates.near_duplicates(docs, shingle).select("doc_id", near_duplicates.hex16("fp").alias("f"), "component_id").collect()
    texts = dict(enumerate(TEXTS))
    fp = {i: brute_fingerprint(t, shingle) for i, t in texts.items()}
    root = union_find([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    assert len(got) == len(TEXTS) + 2
    assert all((r.f, r.component_id) == (f"{fp[r.doc_id]:016x}", root[r.doc_id]) for r in got if r.doc_id is not None)
    kept = near_duplicates.deduplicate(docs, shingle)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(root.values()))
    assert near_duplicates.near_duplicates(none).count() == 0


def test_simhash_links_two_bits(spark):
    start = [int(x) for x in RNG.integers(-(2**62), 2**62, 30)]
    fps = sorted({f ^ (m - (1 << 64) if m >> 63 else m) for f in start for m in [0, *(1 << int(a) | 1 << int(b) for a, b in RNG.integers(0, 64, (12, 2)))]})
    found = near_duplicates.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert union_find([(r.a, r.b) for r in found], fps) == union_find(near, fps) and {(r.a, r.b) for r in found} <= set(near)


def test_language_model(docs, none):
    got = rows(language_model.score(docs))
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    all_rows = [(r.doc_id, "no id here" if r.doc_id is None else TEXTS[r.doc_id]) for r in got]
    train = Counter(w for i, t in all_rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(train.values()), len(train)
    for r, (_, t) in zip(got, all_rows, strict=True):
        w = words(t)
        base = sum(log10((train[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert language_model.score(none).count() == 0


def brute_ctw(train, texts, depth):
    """Directly recursive weighting over (context, bit prefix) nodes, with the same contexts."""

    def events(word_list):
        lists = language_model.tokens(pa.array(word_list))
        for terms in lists.to_pylist():
            yield [int(g) for t in terms for g in language_model.grams(pa.array([t], pa.binary()), depth).flatten().to_pylist()]

    counts = defaultdict(lambda: [0, 0])
    steps = lambda g: [((1 << k) | ((g & 255) >> (8 - k)), (g & 255) >> (7 - k) & 1) for k in range(8)]
    children = defaultdict(set)
    for per in events(train):
        for g in per:
            for prefix, bit in steps(g):
                for d in range(depth + 1):
                    c = (g >> 8) & ((1 << (8 * d)) - 1)
                    counts[d, c, prefix][bit] += 1
                    if d < depth:
                        children[d, c, prefix].add((d + 1, (g >> 8) & ((1 << (8 * (d + 1))) - 1), prefix))
    weighted = {}
    for d in range(depth, -1, -1):
        for node in [k for k in counts if k[0] == d]:
            kt = float(language_model.log_kt(np.float64(counts[node][0]), np.float64(counts[node][1])))
            below = sum(weighted[c] for c in children[node])
            weighted[node] = (kt, below, kt) if d == depth else (np.logaddexp(kt, below) - np.log(2), below, kt)
            weighted[node] = weighted[node][0] if d == depth else weighted[node][0]
    out = []
    for per in events(texts):
        total = 0.0
        for g in per:
            for prefix, bit in steps(g):
                p = 0.5
                for d in range(depth, -1, -1):
                    node = (d, (g >> 8) & ((1 << (8 * d)) - 1), prefix)
                    if node not in counts:
                        continue
                    zero, one = counts[node]
                    kt_p = ((one if bit else zero) + 0.5) / (zero + one + 1)
                    if d == depth:
                        p = kt_p
                    else:
                        kt = float(language_model.log_kt(np.float64(zero), np.float64(one)))
                        share = 1 / (1 + np.exp(sum(weighted[c] for c in children[node]) - kt))
                        p = share * kt_p + (1 - share) * p
                total += np.log10(p)
        out.append(total)
    return out


def test_language_model_is_context_tree_weighting(spark):
    texts = [prose(30, s) for s in range(200, 216)] + ["", "the river", "zzz the qqq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_ctw(train, texts, language_model.DEPTH)
    assert [r.score for r in rows(language_model.score(df))] == pytest.approx(want, rel=1e-5)


def test_language_model_sums_to_one():
    """The probabilities of all bytes after a context sum to one, seen contexts or not."""
    gram = np.concatenate([(c << 8) | np.arange(256) for c in (0x206162, 0x7A7A7A)]).astype(np.int64)
    count = np.where(np.isin(gram & 255, [97, 98, 200]) & (gram >> 8 == 0x206162), 9, 0)
    state, bits, _, _, one = language_model.subtrees(gram, count, language_model.DEPTH, 0)
    p = np.where(bits == 1, one[state], 1 - one[state]).prod(axis=1).reshape(2, 256)
    assert p.sum(axis=1) == pytest.approx([1, 1])


def test_pack():
    group, count = np.array([3, 3, 7, 9, 9, 9]), np.array([1, -1, 2**40 + 5, 0, 2**31, 7])
    lp = np.linspace(-9, 0, 6).astype("<f4")
    names, packed = blocks.pack(group, np.arange(6, dtype="<i4"), *count.view("<i4").reshape(-1, 2).T, lp)
    assert names.tolist() == [3, 7, 9] and [len(x) for x in packed.to_pylist()] == [32, 16, 48]
    got = language_model._unpacked(pa.table({"packed": packed}))
    assert got["pos"].tolist() == list(range(6)) and got["count"].tolist() == count.tolist() and got["lp"].tolist() == lp.tolist()
    assert len(blocks.pack(group[:0], count[:0].astype("<i4"))[1]) == 0


def test_language_model_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(97, 101, (3000, 7)) @ (1 << (8 * np.arange(7))))
    batch = pa.record_batch({"gram": gram, "count": rng.integers(0, 9, len(gram))})
    once = language_model._tops(language_model._pieces([batch], 3), 6, 3)
    monkeypatch.setattr(language_model, "PIECE", 50)
    pieces = language_model._pieces([batch], 3)
    assert len(pieces) > 10 and sorted(np.concatenate([g for g, _ in pieces])) == gram.tolist()
    many = language_model._tops(pieces, 6, 3)
    assert many.keys.tolist() == once.keys.tolist() and many.weighted == pytest.approx(once.weighted)
    assert once.weighted == pytest.approx(language_model.subtrees(gram, batch.column("count").to_numpy(), 6, 2)[2].weighted)


def test_sharding(spark, docs, none):
    got = sharding.assign(docs).collect()
    assert len(got) == len(TEXTS) + 2
    text = dict(enumerate(TEXTS)) | {None: "no id here"}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    even = spark.createDataFrame([(i, prose(int(n), i)) for i, n in enumerate(RNG.integers(5, 60, 3000))] + [(9000 + i, "copy " * 30) for i in range(1500)], "doc_id long, text string")
    found = sharding.assign(even).collect()
    sums, slots = Counter(), defaultdict(list)
    for r in found:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(sums.values()) / 24
    assert set(sums) == set(range(24)) and all(abs(s - mean) < 0.05 * mean for s in sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(none).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS) + 2 and set(docs.columns) < set(back.columns)


URLS = [None, "", "no scheme", "http://", "HTTP://Shop.Example.NET/en/1?x", "https://a.net", "https://a.net/", "http://x.org/fr/2#y", "http://x.org/fr", "http://net/q",
        "http://cheappills.example.com/en/1", "http://blueriver.example.com/en/2", "http://a.example.com/de/9", "http://h.com?://z/", "x://ÄB.Org/FR/", "http://" + "river" * 400 + ".com/" + "p" * 5000,
        *(f"http://stone{i}.example.com/en/{i}" for i in range(40))]


def test_url_filters(spark):
    html = "<p>" + prose(400, 3).replace("Σίσυφος", "cheap") + "</p>"
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, "h") for i, u in enumerate(URLS)] + [(4, URLS[4], html, "h")], "page_id long, url string, html string, host string")
    given = url_filters.rules("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
    got = rows(url_filters.judge(pages, given), "page_id")
    assert len(got) == len(URLS) + 1
    for r in got:
        rest = (URLS[r.page_id] or "").split("://", 1)
        m = re.match(r"([^/?#]*)([^?#]*)", rest[1] if len(rest) == 2 else "", re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        fits = [g for g in given if (host == g.host or host.endswith("." + g.host)) and m[2].startswith(g.path)]
        rule = max(fits, key=lambda g: len(g.text), default=None)
        assert (r.host, r.path, r.rule) == (host, m[2], rule and rule.text)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    assert {r.verdict for r in got if r.page_id == 10} == {"block"} and {r.verdict for r in got if r.page_id == 11} == {"allow"}
    assert url_filters.judge(pages.where("false"), given).count() == 0
    assert url_filters.allowed(pages, given).columns == pages.columns


def test_viterbi():
    counts = {"cheap": 50, "pills": 40, "blue": 100, "a": 500}
    assert url_filters.viterbi("cheappills", counts, 1000) == ["cheap", "pills"]
    assert url_filters.viterbi("zzblue", counts, 1000) == ["zz", "blue"] and url_filters.viterbi("", counts, 1000) == []


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(len(x), window)
        windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if n else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s : s + n]) in windows:
                hit.update(range(s, s + n))
                ids.add(i)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


def test_decontamination(spark, docs, none):
    items = [(1, prose(30, 14)), (12, prose(12, 500)), (3, "Two WORDS"), (4, None), (5, "!!"), (6, "one"), (7, "one one"), (8, LONG[:3000]), (8, "walks"), (2, prose(9, 2)), (1, prose(30, 14)), (None, "here")]
    extra = [(900, f"x {prose(12, 500)} y"), (901, prose(12, 500) + " " + prose(12, 500)), (902, " ".join(prose(12, 500).split()[1:]))]
    data = docs.select("doc_id", "text", "size").union(spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "1.0"))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "'t' as item")
    texts = dict(enumerate(TEXTS)) | {None: "no id here"} | dict(extra)
    got = rows(decontamination.report(data, bench))
    assert len(got) == len(TEXTS) + 2 + len(extra)
    for r in got:
        n, hit, ids = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0), r
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    clean = decontamination.clean(data, bench)
    assert clean.columns == data.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in got if not r.contaminated)
    assert decontamination.report(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.report(data, bench.where("false")).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma " + "y " * 50), (2, "alpha " + "y " * 40 + "beta gamma"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "gamma beta alpha")], "item_id long, text string")
    got = decontamination.proximity_matches(docs, items, 3, 10).collect()
    assert [(r.item_id, r["first"], r["last"]) for r in got] == [(7, 0, 5)]


def test_line_dedup(spark, docs, none):
    tail = [prose(12, 700 + i) for i in range(12)]
    texts = [f"{tail[i]}\nPage {i} of {100 + i} printed by user{i} on host{i}\n{prose(14, 800 + i)}\nAll rights reserved." for i in range(6)]
    texts += [f"{tail[i]}\n\nstatus report for unit {'alpha beta gamma delta'.split()[i - 6]} is ready now please" for i in range(6, 10)]
    texts += [tail[10] + "\n" + tail[11]] * 5  # copies: nothing recurs but the whole document
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, drop_ int")
    got = rows(line_dedup.report(df))
    assert [r.n_dropped for r in got] == [2] * 6 + [1] * 4 + [0] * 5
    assert [r.n_lines for r in got] == [4] * 6 + [2] * 4 + [2] * 5
    assert got[0].text == f"{tail[0]}\n{prose(14, 800)}" and got[7].text == f"{tail[7]}\n" and got[12].text == texts[12]
    cut = line_dedup.deduplicate_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert line_dedup.report(docs).count() == docs.count() and line_dedup.report(none).count() == 0


def test_pipeline(spark, tmp_path):
    from corpus_pipeline import STAGES, run

    passage = prose(40, 900)
    good = [(i, "\n".join(prose(25, 2000 + 3 * i + k).capitalize() + "." for k in range(3))) for i in range(60)]
    junk = [(100 + i, "### !!! $$$ %%% " * 40) for i in range(30)]
    extra = [(200, good[0][1]), (201, good[0][1]), (202, prose(60, 5000) + " " + passage + " " + prose(60, 5001))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in good + junk + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in STAGES] == ["quality_classifier", "line_deduplication", "simhash_near_dedup", "benchmark_decontamination", "vector_packing"]
    out = run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(60))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns

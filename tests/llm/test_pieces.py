"""Pieces, ids and source bytes against the sentencepiece library, for several character maps."""

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from tidemark.llm import pieces
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = np.random.default_rng(11)
TEXTS = [
    "", " ", "  \n\t ", "one", " two  words   here ", "▁ ▁▁x ▁", "日本語 \U0001f600 ﬁ ﬀ ① ½ Å Ǆ ꟹ 　 q​", "ｶﾞ x́ été\u0085x y \x1c z\x00",
    "</s> <unk> <0x0A>", "a" * 300, "ab" * 5_000, "z" + " " * 70 + "y", "".join(map(chr, RNG.integers(33, 0x2FFF, 500))), " ".join("".join(RNG.choice(list("aehilnorstuü_"), n)) for n in RNG.integers(1, 90, 400)),
]


def model(rule, prefix, squeeze, fallback=True):
    proto, norm = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    norm.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = proto.normalizer_spec
    spec.precompiled_charsmap = norm.normalizer_spec.precompiled_charsmap
    spec.add_dummy_prefix, spec.remove_extra_whitespaces = prefix, squeeze
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pieces.BYTE:
                p.type, p.piece = pieces.CONTROL, f"[{p.piece}]"
    return proto.SerializeToString()


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix,squeeze,fallback", [(True, True, True), (True, False, True), (False, True, False), (False, False, False)])
def test_like_the_library(rule, prefix, squeeze, fallback):
    raw = model(rule, prefix, squeeze, fallback)
    library, own = SentencePieceProcessor(), pieces.Model(raw)
    library.LoadFromSerializedProto(raw)
    n, ids, start, stop = own.encode(pa.array(TEXTS), False)
    at = 0
    for text, k in zip(TEXTS, n):
        expected = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids[at : at + k].tolist(), start[at : at + k].tolist(), stop[at : at + k].tolist())) == expected, text[:40]
        at += k


def test_longest_prefix_wins():
    """'e' + acute becomes one letter although 'e' alone is in no rule and the accent is."""
    own = pieces.Model(model("nfkc", False, False))
    norm, origin = own.map.apply("xéﬁ!")
    assert norm == "xéfi!" and origin.tolist() == [0, 1, 4, 4, 7, 8]


def test_query_on_odd_rows(spark):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "b"), (None, "no id", None), (99, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = SentencePieceProcessor(model_file=PATH)
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    known = {i: t for i, t, _ in rows}
    for r in got:
        text = known[r.doc_id] or ""
        assert r.ids == library.encode(text, add_eos=True) and r.decoded == library.decode(r.ids)
        covered = b"".join(text.encode()[a:b] for a, b in zip(r.starts, r.ends))
        assert covered == text.encode()  # with this model the spans tile the text
        assert len(r.starts) == len(r.ends) == len(r.ids)
    assert pieces.encode(docs.where("false"), PATH).count() == 0
    assert pieces.encode(docs, PATH, add_end=False).where("doc_id = 99").first().ids == []


def test_query_digests(spark):
    base = "/root/testdata/sf0.001"
    library = SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = QUERIES["op11_pieces"](spark, base).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())

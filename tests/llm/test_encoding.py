import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import sentencepiece_codec as S
from sparkfolio.llm.queries import piece_model


@pytest.fixture(scope="module")
def both():
    sentencepiece = pytest.importorskip("sentencepiece")
    model = piece_model()
    return S.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def check(both, text):
    codec, library = both
    ids = np.frombuffer(codec.encode_ids(text), "<u4").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert codec.decode(codec.encode_ids(text)).decode() == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    check(both, text.encode("utf-8", "replace").decode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["th", "e", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "ing", ".", "<s>", "<0x0A>", "A", "!!", "&&&", "\r", "0"]), max_size=30))
def test_mixed_pieces(both, parts):
    check(both, "".join(parts))


@pytest.mark.parametrize("n", [*range(40), 1000])
def test_runs_of_spaces(both, n):
    for text in (" " * n, " " * n + "a", "a" + " " * n + "\n" + " " * n):
        check(both, text)


def test_pieces_side_by_side(both):
    rng = random.Random(1)
    pieces = [p.replace("▁", " ") for p in both[0].pieces[259:]]
    for _ in range(5000):
        check(both, "".join(rng.choices(pieces, k=rng.randint(1, 8))))


def test_very_long_words(both):
    rng = random.Random(2)
    check(both, "".join(rng.choices("abcdefghij", k=30_000)))
    check(both, "a" * 20_000)


def test_decoding_of_loose_bytes(both):
    codec, library = both
    for ids in ([3 + 0xE6], [3 + 0xE6, 3 + 0x97, 264], [264, 3 + 0xFF, 3 + 0xC3, 3 + 0xA9]):
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids)


def test_documents(spark, both):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as ids", "1 as decoded", "2 as n_tokens", "3 as `a.b`")
    out = S.digests(S.encode_documents(df, piece_model())).collect()
    assert len(out) == 5 and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {2}
    assert S.encode_documents(df.limit(0), piece_model()).count() == 0


def test_query_equals_library(spark, sf_dir, both):
    import hashlib

    from sparkfolio.llm.queries import op1_sentencepiece

    got = {r.doc_id: r for r in op1_sentencepiece(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = both[1].encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()

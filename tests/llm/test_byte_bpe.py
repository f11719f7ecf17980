import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import byte_bpe as B
from sparkfolio.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    raw = vocabulary()
    return B.ByteBpe(raw), tokenizers.Tokenizer.from_str(raw.decode())


def ids_of(code):
    return np.frombuffer(code, "<u4").tolist()


def check(both, texts):
    codec, library = both
    for text, code in zip(texts, codec.encode_all(texts)):
        ids = ids_of(code)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_texts(both, texts):
    check(both, texts)


SIGNS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'ll", "é", "日本", "😀", "12", ".", "!!", "<|endoftext|>", "<|", " ", " ", "\x1c", "\x85", "\x00", "՘", "\U00010940", " The", "--------", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=25).map("".join), max_size=5))
def test_white_space_and_added_tokens(both, texts):
    check(both, texts)


def test_tokens_side_by_side(both):
    rng = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in both[0].ids]
    check(both, ["".join(rng.choices(tokens, k=rng.randint(1, 8))) for _ in range(5000)])


def test_very_long_words(both):
    rng = random.Random(2)
    check(both, ["a" * 20_000, "".join(rng.choices("abcdefghij", k=30_000)), " " * 5000, "\n" * 3000, "=-" * 5000])


def test_small_cache_gives_the_same(both):
    """Pieces leave the cache and come back."""
    rng = random.Random(3)
    small = B.ByteBpe(vocabulary(), cache_pieces=40)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(20)) for _ in range(3)]
        assert small.encode_all(texts) == both[0].encode_all(texts)


def test_loose_bytes(both):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 5))]
        assert both[0].decode(ids).decode() == both[1].decode(ids, skip_special_tokens=False)


def test_trie_in_depth_first_order():
    rng = random.Random(5)
    words = {bytes(rng.choices(b"ab\x00", k=rng.choice([1, 2, 3, 5, 31, 32, 33, 40]))) for _ in range(300)} | {b"a" * n for n in (31, 32, 33, 70)}
    path, found, nodes = bytearray(), [], set()
    for byte, depth, word in B.Trie(words).preorder():
        del path[depth - 1 :]
        path.append(byte)
        assert bytes(path) not in nodes  # each prefix once
        nodes.add(bytes(path))
        if word is not None:
            assert word == bytes(path)
            found.append(word)
    assert found == sorted(words) and nodes == {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert not list(B.Trie([]).preorder())


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        B.ByteBpe(vocabulary("word_bpe_49k.json"))


def test_documents(spark, both):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b")]
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc.id").selectExpr("*", "'old' as ids", "1 as decoded", "2 as n_tokens", "3 as `a.b`")
    coded = B.encode_documents(df, vocabulary(), id_col="doc.id")
    out = B.digests(coded, "doc.id").collect()
    assert len(out) == 5 and {r.n_tokens for r in out if r["doc.id"] in (2, 3)} == {0}
    assert sorted((r.decoded for r in coded.collect())) == ["", "", "a b", "a b", "x"]
    assert B.encode_documents(df.limit(0), vocabulary(), id_col="doc.id").count() == 0


def test_query_equals_library(spark, sf_dir, both):
    import hashlib

    from sparkfolio.llm.queries import op11_byte_bpe

    got = {r.doc_id: r for r in op11_byte_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = both[1].encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()

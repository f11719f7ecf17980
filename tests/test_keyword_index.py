"""The stored index against plain readings: bounds that leave nothing out, segments that are refreshed, merged and taken away."""

import math
import random
import re
from collections import Counter

import pytest

from sparkfolio.operators import keyword_index, search

WORDS = ["the", "of", "and", "in"] * 20 + [f"mid{i}" for i in range(12)] * 3 + [f"rare{i}" for i in range(60)]


def some_rows(rng, ids):
    return {i: " ".join(rng.choices(WORDS, k=rng.choice([1, 5, 30, 60]))) for i in ids}


def brute(questions, rows, k):
    """Each query alone, in plain Python."""
    toks = {i: re.findall(r"\w+", t or "") for i, t in rows.items()}
    df = Counter(w for t in toks.values() for w in set(t))
    n, average = len(toks), sum(map(len, toks.values())) / max(len(toks), 1)
    out = set()
    for q, text in questions:
        scores = {}
        for w in text.split():
            if not df[w]:
                continue
            idf = max(1e-6, math.log((n - df[w] + 0.5) / (df[w] + 0.5)))
            for i, t in toks.items():
                if tf := t.count(w):
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
        ranked = sorted((round(-s, 6), i) for i, s in scores.items())
        out |= {(q, i, s, r + 1) for r, (s, i) in enumerate(ranked[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    old = keyword_index.BLOCK_ROWS
    keyword_index.BLOCK_ROWS = 8
    rows = some_rows(random.Random(1), range(600))
    yield rows, keyword_index.build(frame(spark, rows), str(tmp_path_factory.mktemp("index") / "i"))
    keyword_index.BLOCK_ROWS = old


QUESTIONS = [(1, "the rare1 rare2"), (2, "the of and in mid1 mid1 mid2 rare3"), (3, "the"), (4, "nothing"), (5, "rare4"), (6, " ".join(WORDS[::5])), (7, "")]


@pytest.mark.parametrize("prune_from", [0, 10**9])
@pytest.mark.parametrize("k", [1, 40])
def test_ranked_search_leaves_nothing_out(spark, stored, k, prune_from, monkeypatch):
    monkeypatch.setattr(search, "PRUNE_FROM", prune_from)
    rows, index = stored
    q = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    assert {tuple(r) for r in search.bm25(q, index, k).collect()} == brute(QUESTIONS, rows, k)


@pytest.mark.parametrize("prune_from", [0, 10**9])
def test_ranked_search_within_scopes(spark, stored, prune_from, monkeypatch):
    monkeypatch.setattr(search, "PRUNE_FROM", prune_from)
    rows, index = stored
    q = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    allowed = [(q_, i) for q_ in (1, 2, 3) for i in rows if i % (q_ + 2) == 0]
    scope = spark.createDataFrame([(1,), (2,), (3,), (5,)], "query_id long"), spark.createDataFrame(allowed, "query_id long, id long")
    got = {tuple(r) for r in search.bm25(q, index, 10, scope=scope).collect()}
    everything = brute(QUESTIONS, rows, None)
    want = set()
    for q_ in range(1, 8):
        ranked = sorted((s, i) for x, i, s, _ in everything if x == q_ and (q_ not in (1, 2, 3, 5) or (q_, i) in set(allowed)))
        want |= {(q_, i, s, r + 1) for r, (s, i) in enumerate(ranked[:10])}
    assert got == want


def test_bounds_save_postings(spark, stored):
    _, index = stored
    q = spark.createDataFrame([(1, "the of rare1 rare2 rare3 rare4")], "query_id long, question string")
    read = search.postings_read(q, index, 3).first()
    assert read.essential < read.asked / 3 and read.in_blocks < read.asked


def test_phrases_beside_words(spark, tmp_path):
    rows = {1: "state of the art", 2: "the state art", 3: "art state-of the", 4: "state of of the"}
    index = keyword_index.build(frame(spark, rows), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "state-of art"), (2, "state-of"), (3, "the art"), (4, "art zebra")], "query_id long, question string")
    found = {(r.query_id, r.id) for r in search.match_all(q, index).collect()}
    assert found == {(1, 1), (1, 3), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3)}
    assert sorted(search.bm25(q, index, 40).collect()) == sorted(search.bm25(q, frame(spark, rows), 40, "id", "text").collect())


def test_random_refreshes_deletes_and_merges(spark, tmp_path):
    rng = random.Random(3)
    rows = some_rows(rng, range(60))
    folder = str(tmp_path / "i")
    index = keyword_index.build(frame(spark, rows), folder)
    first, first_rows = index, dict(rows)
    asked = [(1, "the mid1 mid2"), (2, "rare1 of"), (3, "anew")]
    q = spark.createDataFrame(asked, "query_id long, question string")
    for step in range(5):
        ids = rng.sample(range(90), rng.choice([1, 3, 9]))
        change = some_rows(rng, ids) | {ids[0]: None if step == 2 else "anew the"}
        gone = rng.sample(sorted(set(rows) - set(ids)), step % 3)
        index = keyword_index.refresh(frame(spark, change), folder, gone=spark.createDataFrame([(i,) for i in gone], "id long"))
        rows |= change
        for i in gone:
            del rows[i]
        assert (index.n, index.total) == (len(rows), sum(len((t or "").split()) for t in rows.values()))
        # No segment but the first of a run is smaller than MERGE times what comes after it.
        sizes = [s.rows for s in index.segments]
        assert all(sizes[i] >= keyword_index.MERGE * sum(sizes[i + 1 :]) for i in range(len(sizes)))
        df = Counter(w for t in rows.values() for w in set((t or "").split()))
        assert {r.token: r.df for r in index.terms.collect()} == df
    assert {tuple(r) for r in search.bm25(q, index, 10).collect()} == brute(asked, rows, 10)
    want = {(q_, i) for q_, text in asked for i, t in rows.items() if set(text.split()) <= set((t or "").split())}
    assert {tuple(r) for r in search.match_all(q, index).collect()} == want
    # What was opened before reads what it read then.
    assert {tuple(r) for r in search.bm25(q, first, 10).collect()} == brute(asked, first_rows, 10)


def test_segments_without_merging_give_the_same(spark, tmp_path):
    rng = random.Random(4)
    rows = some_rows(rng, range(40))
    folder = str(tmp_path / "i")
    keyword_index.build(frame(spark, rows), folder)
    for _ in range(3):
        change = some_rows(rng, rng.sample(range(50), 6))
        rows |= change
        index = keyword_index.refresh(frame(spark, change), folder, merge=False)
    assert len(index.segments) == 4
    asked = [(1, "the mid1"), (2, "of rare1 rare2 mid3")]
    q = spark.createDataFrame(asked, "query_id long, question string")
    assert {tuple(r) for r in search.bm25(q, index, 10).collect()} == brute(asked, rows, 10)
    assert {tuple(r) for r in search.bm25(q, keyword_index.merged(spark, folder), 10).collect()} == brute(asked, rows, 10)

"""Titles sought by keys: texts' words meet the few that titles are sought by, and texts aren't shuffled."""

import random

import pytest

from sparkfolio.operators import graphs


def some(rng):
    words = [f"term{i}x" for i in range(12)] + ["a", "of", "electroencephalography"]
    texts = [(i, None if i % 20 == 3 else " ".join(rng.choices(words, k=30)) + rng.choice(["", "s", " pre"]) + rng.choice(words)) for i in range(60)]
    titles = []
    for k in range(80):
        source = texts[rng.randrange(60)][1] or "some title of its own"
        start = rng.randrange(max(1, len(source) - 50))
        titles.append((100 + k, source[start : start + rng.choice([20, 24, 45])].strip()))  # cut anywhere, inside words too
    return texts, [t for t in titles if len(t[1]) >= 20] + [(300, "cephalography electro" + "x" * 5), (301, "electroencephalograph")]


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_titles_by_keys_equal_containment(spark, monkeypatch, most):
    monkeypatch.setattr(graphs, "HITS_BYTES", most)
    texts, titles = some(random.Random(8))
    found = graphs._titles_by_keys(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(titles, "target long, sought string"), 20)
    want = {(i, t) for i, text in texts for t, title in titles if text and title in text}
    assert {(r.source, r.target) for r in found.collect()} == want and len(want) > 80


def test_texts_and_their_words_are_not_shuffled(spark):
    texts, titles = some(random.Random(9))
    found = graphs._titles_by_keys(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(titles, "target long, sought string"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan

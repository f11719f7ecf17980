import numpy as np
import pytest

from sparkfolio.functions.text import aggressive_key
from sparkfolio.operators import graphs


@pytest.mark.parametrize("vectors", [False, True])
def test_rounds_give_what_one_item_after_the_other_gives(spark, vectors):
    """Keys and likenesses that overlap in chains, and ties of keys; ids that say nothing of the places."""
    rng = np.random.default_rng(1)
    n = 120
    labels = [rng.choice(["Graph", "graphs", "Tree", "trees", "GRAPH-s", *[f"word {i}" for i in range(40)]]) for _ in range(n)]
    turn = np.sort(rng.uniform(0, 8, n)) if vectors else rng.uniform(0, 1, n)
    points = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    order = rng.permutation(n)
    rows = [(f"t{(i * 7) % n}", int(order[i]), str(labels[i]), points[i].tolist()) for i in range(n)]
    units = spark.createDataFrame(rows, "tag_id string, place long, label string, v array<double>").repartition(3)
    got = {r.tag_id: r.keep_id for r in graphs.duplicate_tags(units, 0.995, "v" if vectors else None).collect()}
    sorted_rows = sorted(rows, key=lambda r: r[1])
    keys = {r.tag_id: r.key for r in units.select("tag_id", aggressive_key(units.label).alias("key")).collect()}
    led = graphs.leader_groups([keys[r[0]] for r in sorted_rows], np.array([r[3] for r in sorted_rows]) if vectors else None, 0.995)
    assert got == {r[0]: sorted_rows[k][0] for r, k in zip(sorted_rows, led)}
    assert len(set(got.values())) < n


def test_no_tags(spark):
    assert graphs.duplicate_tags(spark.createDataFrame([], "tag_id long, place long, label string")).count() == 0

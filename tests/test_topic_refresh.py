import random
from collections import Counter

import numpy as np

from sparkfolio.operators import graphs
from sparkfolio.sources import versions


def edges(df):
    return Counter((r.a, r.b, r.kind, round(r.weight, 6)) for r in df.collect())


def test_random_refreshes_equal_full_builds(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "t")
    vectors = {t: np.random.default_rng(t).normal(size=4) for t in range(12)}
    state = {(rng.randrange(12), rng.randrange(15)) for _ in range(60)}
    for step in range(4):
        before = set(state)
        if step:
            state -= {m for m in state if m[0] == step or m[0] == 5 and rng.random() < 0.5}
            state |= {(rng.choice([7, 11]), rng.randrange(15)) for _ in range(3)}
        if step == 3:
            vectors[2] = vectors[4]
        changed = {t for t, _ in state ^ before} if step else {t for t, _ in state}
        rows = spark.createDataFrame([(t, f"tag {t}", p) for t, p in state] * 2 + [(None, "x", 1), (1, "tag 1", None)], "tag_id long, label string, paper_id long")
        vec = spark.createDataFrame([(t, (v / np.linalg.norm(v)).tolist()) for t, v in vectors.items()], "id long, embedding array<double>")
        assert graphs.refreshed_topics(rows, vec, folder, 0.3, 2) == len(changed)
        assert edges(graphs.topic_table(spark, folder)) == edges(graphs.topic_edges(rows.select("tag_id", "paper_id").where("tag_id is not null"), vec, 0.3, 2))
        assert {tuple(r) for r in versions.opened(spark, folder).table("links").collect()} == state
    assert graphs.refreshed_topics(rows, vec, folder, 0.3, 2) == 0 and versions.opened(spark, folder).version == 3

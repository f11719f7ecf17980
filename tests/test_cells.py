import numpy as np
import pytest

from sparkfolio.operators import cells


def brute(rows, threshold):
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a != b and x is not None and y is not None and len(x) == len(y) and (s := float(np.dot(x, y))) >= threshold:
                out[min(a, b), max(a, b)] = round(s, 9)
    return out


@pytest.fixture()
def small(monkeypatch):
    """Blocks so small that bounds and the dealing of heads matter."""
    for name, value in (("BLOCK", 8), ("TOGETHER", 2), ("HEADS", 7), ("PIVOTS", 20)):
        monkeypatch.setattr(cells, name, value)


def test_pairs_equal_brute_force(spark, small):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=6) * (0.05 if i % 3 else 0.5)
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    rows += [(300, None), (301, [1.0, 0.0]), (302, [1.0, 0.0]), (303, [0.0] * 6), (304, rows[0][1]), (305, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    for threshold in (0.95, 0.5, -0.2):
        got = {(r.a, r.b): round(r.score, 9) for r in cells.similar_pairs(df, threshold, "id", "v").collect()}
        assert got == pytest.approx(brute(rows, threshold))
    met = cells.blocks_met(df, 0.95, "id", "v").first()
    assert met.met < met.pairs


def test_each_pair_once(spark, small):
    rows = [(i, [1.0, float(i % 2)]) for i in range(60)]
    found = [(r.a, r.b) for r in cells.similar_pairs(spark.createDataFrame(rows, "id long, v array<float>"), 0.5, "id", "v").collect()]
    assert len(found) == len(set(found)) == 60 * 59 // 2


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "id long, v array<double>")
    assert cells.similar_pairs(df, 0.5, "id", "v").count() == 0
    assert cells.similar_pairs(df.limit(0), 0.5, "id", "v").count() == 0


def test_no_cartesian_product(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = cells.similar_pairs(df, 0.8, "vec_id", "embedding")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert {(r.a, r.b) for r in found.collect()} == set(brute(rows, 0.8))


def brute_nearest(rows, asked, k):
    out = set()
    for q, x in asked:
        ranked = sorted((-round(float(np.dot(x, v)), 12), i) for i, v in rows.items() if v is not None and len(v) == len(x) and i != q)
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(ranked[:k])}
    return out


def test_stored_index_after_refreshes(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PACK", 5)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(15, 5)) * 3
    vector = lambda i: (centres[i % 15] + rng.normal(size=5) * 0.1).tolist()
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, embedding array<double>").repartition(3)
    rows = {i: vector(i) for i in range(400)} | {400: [1.0, 2.0], 401: [2.0, 1.0], 402: None}
    asked = [(i, rows[i]) for i in (0, 7, 44, 100, 101, 333, 400)] + [(1000, [0.0] * 5)]
    queries = spark.createDataFrame([*asked, (1001, None)], "id long, embedding array<double>")
    first = cells.build(frame(rows), str(tmp_path / "v"))
    for k in (1, 6, 500):
        assert {(r.query_id, r.id, r.rank) for r in cells.nearest(queries, first, k).collect()} == brute_nearest(rows, asked, k)
    assert cells.Search(queries, first, 3).share_read() < 0.6
    # A query that is one of the vectors counts for no bound: all queries are vectors here, and blocks hold just k of them.
    own = frame({i: rows[i] for i in range(0, 400, 5)})
    assert {(r.query_id, r.id, r.rank) for r in cells.nearest(own, first, 8).collect()} == brute_nearest(rows, [(i, rows[i]) for i in range(0, 400, 5)], 8)
    before = dict(rows)
    for change in ({5: vector(9), 6: None, 500: vector(3)}, {500: None, 501: vector(1), 5: vector(5), 44: rows[45]}):
        rows |= change
        index = cells.refresh(frame(change), str(tmp_path / "v"))
        assert {(r.query_id, r.id, r.rank) for r in cells.nearest(queries, index, 6).collect()} == brute_nearest(rows, asked, 6)
    assert {(r.query_id, r.id, r.rank) for r in cells.nearest(queries, first, 6).collect()} == brute_nearest(before, asked, 6)

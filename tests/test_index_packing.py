"""The index of texts: postings packed where a block's texts meet, without a shuffle of single postings."""

import pyarrow as pa

from sparkfolio.operators import keyword_index

TEXTS = [(5, "b a b"), (3, "a a"), (9, None), (7, ""), (-2, "é e b, a"), (11, "c")]


def test_packed_blocks_hold_all_postings(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    index = keyword_index.build(docs, f"file://{tmp_path}/index")
    got = sorted((r.token, r.id, r.tf, r.length, list(r.positions)) for r in index.postings.collect())
    want = sorted((r.token, r.id, r.tf, r.length, list(r.positions)) for r in keyword_index.postings(docs, "id", "text").collect())
    assert got == want and (index.n, index.total) == (6, 10)
    row = index.blocks.where("token = 'a'").first()
    assert list(row.ids) == [-2, 3, 5] and list(row.tfs) == [1, 2, 1] and row.max_tf == 2 and row.min_length == 2


def test_a_block_is_packed_in_one_group():
    rows = pa.table({"block": pa.array([4] * 3, pa.int64()), "id": pa.array([8, 2, 5], pa.int64()), "tokens": pa.array([["x", "y", "x"], ["y"], []], pa.list_(pa.string()))})
    got = {r["token"]: r for r in keyword_index._pack_block(rows).to_pylist()}
    assert got["x"] == {"token": "x", "block": 4, "ids": [8], "tfs": [2], "lengths": [3], "positions": [[0, 2]], "max_tf": 2, "min_length": 3}
    assert got["y"] == {"token": "y", "block": 4, "ids": [2, 8], "tfs": [1, 1], "lengths": [1, 3], "positions": [[0], [1]], "max_tf": 1, "min_length": 1}

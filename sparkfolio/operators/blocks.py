"""Vectors compared in packed blocks: exact products by matrix multiplication, for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Product of two vectors in double precision; the longer one is cut, empty ones give 0."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (ids, x, d, least): up to BLOCK vectors of a partition side by side in binary, and the least id of a block. Null
    vectors are left out. No shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def full():
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.stack(rows).tobytes()]), pa.array([len(rows[0])]), pa.array([min(ids)], pa.int64())], names=["ids", "x", "d", "least"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if len(ids) == BLOCK:
                    yield full()
                    ids.clear()
                    rows.clear()
        if ids:
            yield full()

    return df.select(F.col(id_col).cast("long"), vector_col).where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).mapInArrow(pack, "ids binary, x binary, d long, least long")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str, vector_col: str, at_least: float | None = None, include_self: bool = False) -> DataFrame:
    """Rows (query_id, id, score, rank): the k rows of ``corpus`` nearest to each query, ties by id.

    Blocks of queries meet blocks of the corpus; each meeting returns at most k rows per query, which a window ranks.
    """
    q = packed(queries, id_col, vector_col).select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "d")
    tiles = packed(corpus, id_col, vector_col).select("ids", "x", F.col("d").alias("d_")).crossJoin(q).where("d = d_")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, q_ids, q_x, d in zip(*(batch.column(n).to_pylist() for n in ("ids", "x", "q_ids", "q_x", "d"))):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                s = np.frombuffer(q_x).reshape(-1, d) @ np.frombuffer(x).reshape(-1, d).T
                if not include_self:
                    s[q_ids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 12)), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q_ids)), order.shape[1])
                col = order.ravel()
                value = s[row, col]
                ok = np.isfinite(value) & (value >= at_least if at_least is not None else True)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[ok]]), pa.array(ids[col[ok]]), pa.array(value[ok])], names=["query_id", "id", "score"])

    found = tiles.select("ids", "x", "q_ids", "q_x", "d").mapInArrow(score, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vectors(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """Rows (key, embedding): the sum of each key's vectors, scaled to length 1; a zero sum stays zero."""
    sums = df.select(key, F.posexplode(vector_col)).groupBy(key, "pos").agg(F.sum(F.col("col").cast("double")).alias("s"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return sums.groupBy(key).agg(vector.alias("v")).withColumn("n", norm).select(key, F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("embedding"))

"""Vectors in cells around pivots: blocks with a centre and a radius, whose bounds decide which blocks can hold a similar pair.

For x = c + a and y = e + b, with |a| <= r and |b| <= s, the product x.y is at most c.e + |c| s + |e| r + r s.  Blocks whose bound
stays below the threshold never meet; no row of blocks is crossed with another: what meets is a join on pairs of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.session import stage_path
from sparkfolio.sources import versions

#: Vectors of a block at most, blocks that are dealt together, and heads of blocks that are compared in one group.
BLOCK, TOGETHER, HEADS = 256, 16, 4096
#: Pivots at most: a bounded sample, which decides how tight the blocks are, not what is found.
PIVOTS = 512
#: Bounds leave this much room for rounding.
ROOM = 1e-9


def pivots(df: DataFrame, id_col: str, vector_col: str) -> np.ndarray:
    """At most PIVOTS vectors, those with the least hashes of ids, ordered along the axis on which they differ most."""
    rows = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(vector_col).orderBy(F.xxhash64(id_col)).limit(PIVOTS).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(len(r[0]) for r in rows)
    chosen = np.array([r[0] for r in rows if len(r[0]) == size], np.float64)
    chosen = np.unique(chosen, axis=0)
    axis = np.linalg.svd(chosen - chosen.mean(axis=0), full_matrices=False)[2][0] if len(chosen) > 1 else np.ones(size)
    return chosen[np.argsort(chosen @ axis, kind="stable")]


def _assigned(df: DataFrame, id_col: str, vector_col: str, around: np.ndarray) -> DataFrame:
    """Rows (d, cell, id, x): the nearest pivot of each vector; vectors of another size are in cell 0."""
    sent = df.sparkSession.sparkContext.broadcast(around)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = sent.value
        half = (pivot * pivot).sum(axis=1) / 2
        for batch in batches:
            vectors = [v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in batch.column(1)]
            sizes = np.array([len(v) for v in vectors])
            cell = np.zeros(len(vectors), np.int32)
            at = np.flatnonzero(sizes == (pivot.shape[1] if pivot.size else -1))
            for part in np.array_split(at, max(1, len(at) // 4096)):
                if len(part):
                    cell[part] = (np.stack([vectors[i] for i in part]) @ pivot.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(cell), batch.column(0), pa.array([v.tobytes() for v in vectors])], names=["d", "cell", "id", "x"])

    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return given.where(F.size("v") > 0).mapInArrow(assign, "d long, cell int, id long, x binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that stand side by side and share size and cell, up to BLOCK of them, as one block."""
    key: tuple[int, int] | None = None
    ids: list[int] = []
    rows: list[bytes] = []

    def out() -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows)).reshape(len(ids), key[0])
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) if key[0] else 0.0
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.tobytes()]), pa.array([centre.tobytes()]), pa.array([radius])],
            names=["d", "cell", "ids", "x", "centre", "radius"],
        )

    for batch in batches:
        for d, cell, id_, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if ids and ((d, cell) != key or len(ids) == BLOCK):
                yield out()
                ids.clear()
                rows.clear()
            key = d, cell
            ids.append(id_)
            rows.append(x)
    if ids:
        yield out()


def blocks_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (block, together, d, cell, ids, x, centre, radius), written to the shared folder. Null and empty vectors, and
    null ids, are left out.

    Cells are dealt by ranges, so that a cell with many vectors fills several tasks and neighbouring blocks, which are dealt
    together, have neighbouring cells.
    """
    spark = df.sparkSession
    path = stage_path(spark, "cells")
    _assigned(df, id_col, vector_col, pivots(df, id_col, vector_col)).write.parquet(path)
    rows = spark.read.parquet(path)
    packed = _pack(rows)
    number = F.monotonically_increasing_id()  # a task's number, then the row's; written, so it stays as it is
    packed.select(number.alias("block"), "*").write.parquet(path + "-blocks")
    task, row = F.shiftright("block", 33), F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.parquet(path + "-blocks").withColumn("together", F.shiftleft(task, 33) + F.floor(row / TOGETHER))


def _heads(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = np.frombuffer(b"".join(rows.column("centre").to_pylist())).reshape(rows.num_rows, -1)
    return centre, np.sqrt((centre * centre).sum(axis=1)), rows.column("radius").to_numpy()


def bounds(a: pa.Table, b: pa.Table) -> np.ndarray:
    """The most that a vector of each block of ``a`` and one of each block of ``b`` can have as their product."""
    (c, cn, r), (e, en, s) = _heads(a), _heads(b)
    return c @ e.T + cn[:, None] * s[None, :] + en[None, :] * r[:, None] + r[:, None] * s[None, :]


def _meeting(heads: DataFrame, threshold: float) -> DataFrame:
    """Rows (d, i, j), i <= j: what is dealt together and holds two blocks that can hold a similar pair."""
    groups = max(1, -(-heads.count() // HEADS))
    placed = heads.withColumn("g", F.pmod(F.xxhash64("together"), F.lit(groups)))
    left = placed.withColumn("h", F.explode(F.sequence(F.col("g"), F.lit(groups - 1).cast("long"))))
    others = placed.select(*[F.col(c).alias(c) for c in heads.columns], F.col("g").alias("h"))  # new columns of the same names
    right = others.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h"))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found, d = set(), (a if a.num_rows else b).column("d")[0].as_py()
        if a.num_rows and b.num_rows:
            i, j = np.nonzero(bounds(a, b) >= threshold - ROOM)
            x, y = a.column("together").to_numpy()[i], b.column("together").to_numpy()[j]
            found = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        return pa.table({"d": pa.array([d] * len(found), pa.int64()), "i": pa.array([p[0] for p in found], pa.int64()), "j": pa.array([p[1] for p in found], pa.int64())})

    return left.groupBy("d", "g", "h").cogroup(right.groupBy("d", "g", "h")).applyInArrow(compare, "d long, i long, j long").distinct()


def similar_pairs(df: DataFrame, threshold: float, id_col: str, vector_col: str) -> DataFrame:
    """Rows (a, b, score) with a < b of all pairs whose product reaches the threshold; vectors of different sizes form none.

    Vectors are dealt once for each neighbourhood of blocks that theirs can meet.  An id that stands twice forms no pair with
    itself.
    """
    blocks = blocks_of(df, id_col, vector_col)
    spark, path = df.sparkSession, stage_path(df.sparkSession, "met")
    _meeting(blocks.select("d", "together", "centre", "radius"), threshold).write.parquet(path)
    left, right = (spark.read.parquet(path).join(blocks.select("d", F.col("together").alias(key), "block", "ids", "x", "centre", "radius"), ["d", key]) for key in ("i", "j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out_a, out_b, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            same = a.column("i")[0].as_py() == a.column("j")[0].as_py()
            own, others = a.column("block").to_numpy(), b.column("block").to_numpy()
            parts = lambda t: [(np.frombuffer(i, np.int64), np.frombuffer(x).reshape(len(i) // 8, -1)) for i, x in zip(t.column("ids").to_pylist(), t.column("x").to_pylist())]
            left, right = parts(a), parts(b)
            for i, j in zip(*np.nonzero(bounds(a, b) >= threshold - ROOM)):
                if same and own[i] > others[j]:
                    continue
                (p, x), (q, y) = left[i], right[j]
                s = x @ y.T
                ok = s >= threshold
                ok &= p[:, None] < q[None, :] if own[i] == others[j] else p[:, None] != q[None, :]
                m, n = np.nonzero(ok)
                out_a.append(np.minimum(p[m], q[n]))
                out_b.append(np.maximum(p[m], q[n]))
                out_s.append(s[m, n])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "score": np.concatenate(out_s)})

    return left.groupBy("d", "i", "j").cogroup(right.groupBy("d", "i", "j")).applyInArrow(compare, "a long, b long, score double")


def blocks_met(df: DataFrame, threshold: float, id_col: str, vector_col: str) -> DataFrame:
    """One row (pairs, met): pairs of what is dealt together, and those of them that meet."""
    blocks = blocks_of(df, id_col, vector_col)
    n = blocks.select("together").distinct().agg(F.count("*").alias("n"))
    met = _meeting(blocks.select("d", "together", "centre", "radius"), threshold).agg(F.count("*").alias("met"))
    return n.join(F.broadcast(met)).select((F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("pairs"), "met")


# -- a stored index ----------------------------------------------------------------------------------------------------

#: Queries of a pack at most.
PACK = 256
BLOCKS = "d long, cell int, ids binary, x binary, centre binary, radius double"


def _pack(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("d", "cell", F.xxhash64("id")).sortWithinPartitions("d", "cell").select("d", "cell", "id", "x").mapInArrow(_packed, BLOCKS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, cell, ids, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            n, size = len(ids) // 8, 8 * d
            yield pa.RecordBatch.from_arrays([pa.array([d] * n), pa.array([cell] * n, pa.int32()), pa.array(np.frombuffer(ids, np.int64)), pa.array([x[i * size : (i + 1) * size] for i in range(n)], pa.binary())], names=["d", "cell", "id", "x"])


def build(df: DataFrame, root: str, id_col: str = "id", vector_col: str = "embedding") -> versions.Snapshot:
    """Writes an index of all vectors to a folder's tables, in one commit: pivots, blocks by cell, and each id's cell."""
    spark = df.sparkSession
    around = pivots(df, id_col, vector_col)
    path = stage_path(spark, "assigned")
    _assigned(df, id_col, vector_col, around).write.parquet(path)
    rows = spark.read.parquet(path)
    kept = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(around)], "cell int, x array<double>")
    changes = {"pivots": versions.Change("cell", kept, everything=True), "blocks": versions.Change("cell", _pack(rows), everything=True), "places": versions.Change("id", rows.select("id", "cell"), everything=True)}
    return versions.commit(versions.opened(spark, root), changes)


def refresh(df: DataFrame, root: str, id_col: str = "id", vector_col: str = "embedding") -> versions.Snapshot:
    """Puts vectors in place of those with the same ids, or adds them; a null vector takes its id away.

    Only the cells that lose or get a vector are packed anew, and only the files that hold one of them are written again; who
    opened the index before goes on reading what it was.
    """
    spark = df.sparkSession
    base = versions.opened(spark, root)
    around = np.array([r.x for r in base.table("pivots").orderBy("cell").collect()], np.float64)
    path = stage_path(spark, "assigned")
    _assigned(df, id_col, vector_col, around).write.parquet(path)
    new = spark.read.parquet(path)
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    touched = new.select("cell").unionByName(base.table("places").join(ids, "id", "left_semi").select("cell")).distinct()
    old = base.table("blocks").join(touched, "cell", "left_semi").select("d", "cell", "ids", "x").mapInArrow(_unpacked, "d long, cell int, id long, x binary")
    rows = old.join(ids, "id", "left_anti").select("d", "cell", "id", "x").unionByName(new.select("d", "cell", "id", "x"))
    packed = stage_path(spark, "packed")
    _pack(rows).write.parquet(packed)
    changes = {"blocks": versions.Change("cell", spark.read.parquet(packed), touched), "places": versions.Change("id", new.select("id", "cell"), ids)}
    return versions.commit(base, changes)


def _bounded(heads: pa.Table, packs: pa.Table, k: int) -> pa.Table:
    """Rows (pack, block, first, most): blocks that can hold one of the k best of a pack's queries, by the heads of one group. most:
    the most that a vector of the block can score with each query; first: blocks of some query's highest bounds with k vectors."""
    out: dict[str, list] = {"pack": [], "block": [], "first": [], "most": []}
    if heads.num_rows and packs.num_rows:
        centre, _, radius = _heads(heads)
        block, n = heads.column("block").to_pylist(), heads.column("n").to_numpy()
        for pack, x in zip(packs.column("pack").to_pylist(), packs.column("q").to_pylist()):
            q = np.frombuffer(x).reshape(-1, centre.shape[1])
            middle, spread = q @ centre.T, np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
            most, least = middle + spread, middle - spread
            rows = np.arange(len(q))[:, None]
            by_least, by_most = np.argsort(-least, axis=1), np.argsort(-most, axis=1)
            held = np.cumsum(n[by_least], axis=1) >= k
            # The k-th best score is at least the bound of the block with which k vectors are reached.
            floor = np.where(held.any(axis=1), least[rows[:, 0], by_least[rows[:, 0], held.argmax(axis=1)]], -np.inf)
            wanted = (most >= floor[:, None] - ROOM).any(axis=0)
            first = np.zeros(len(block), bool)
            first[by_most[np.cumsum(n[by_most], axis=1) - n[by_most] < k]] = True
            for b in np.flatnonzero(wanted | first).tolist():
                out["pack"].append(pack)
                out["block"].append(block[b])
                out["first"].append(bool(first[b]))
                out["most"].append(most[:, b].tobytes())
    return pa.table({"pack": pa.array(out["pack"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "first": pa.array(out["first"], pa.bool_()), "most": pa.array(out["most"], pa.binary())})


class Search:
    """The k vectors of an index nearest to each query, best bounds first.

    1. Queries in packs meet the blocks' heads, which say what a block can hold at most; blocks that can't hold any of a query's k
       best, by the heads alone, are never read.
    2. The blocks with the highest bounds are read: their k-th best score is each query's threshold.
    3. Of the others those are read whose bound reaches the threshold of a query.
    """

    def __init__(self, queries: DataFrame, index: versions.Snapshot, k: int, id_col: str = "id", vector_col: str = "embedding", include_self: bool = False):
        self.k, self.include_self, self.spark = k, include_self, queries.sparkSession
        number = F.xxhash64("ids", "cell")
        self.blocks = index.table("blocks").withColumn("block", number)
        rows = _assigned(queries, id_col, vector_col, np.array([r.x for r in index.table("pivots").orderBy("cell").collect()], np.float64))
        self.packs = self._written(rows.repartition("d").sortWithinPartitions("d", "cell").select("d", F.lit(0).alias("cell"), "id", "x").mapInArrow(_packs, "d long, q_ids binary, q binary").withColumn("pack", F.monotonically_increasing_id()), "packs")
        heads = self.blocks.select("d", "block", "centre", "radius", (F.length("ids") / 8).cast("long").alias("n"))
        self.n_blocks = heads.count()
        groups = max(1, -(-self.n_blocks // HEADS))
        enough = k + (not include_self)  # a query may itself be among the vectors that a bound counts
        left = heads.withColumn("g", F.pmod("block", F.lit(groups)))
        right = self.packs.select("d", "pack", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        plan = left.groupBy("d", "g").cogroup(right.groupBy("d", "g")).applyInArrow(lambda a, b: _bounded(a, b, enough), "pack long, block long, first boolean, most binary")
        self.plan = self._written(plan, "plan")
        self.near = self._written(self.scored(self.plan.where("first").select("pack", "block")), "near")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        least = self.near.withColumn("place", place).where(F.col("place") == k).select("query_id", "score")
        self.rest = self._written(self._reaching(least), "rest")

    def _written(self, df: DataFrame, label: str) -> DataFrame:
        path = stage_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _reaching(self, least: DataFrame) -> DataFrame:
        """Rows (pack, block) of blocks not read yet whose bound reaches the threshold of one of the pack's queries."""
        floors = self.packs.select("pack", F.explode(F.expr("sequence(0, cast(length(q_ids) / 8 as int) - 1)")).alias("row"), "q_ids").mapInArrow(_query_ids, "pack long, row int, query_id long")
        known = floors.join(least, "query_id", "left").groupBy("pack").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", F.coalesce("score", F.lit(float("-inf"))).alias("s")))), lambda x: x["s"]).alias("least"))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [bool((np.frombuffer(m) >= np.array(v) - ROOM).any()) for m, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["pack", "block"]).filter(pa.array(ok, pa.bool_()))

        return self.plan.where("not first").join(known, "pack").select("pack", "block", "most", "least").mapInArrow(reach, "pack long, block long")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Rows (query_id, id, score): at most k of each query and block."""
        k, include_self = self.k, self.include_self
        met = pairs.join(self.packs.drop("d"), "pack").join(self.blocks.select("block", "ids", "x"), "block").select("q_ids", "q", "ids", "x")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q_ids, q, ids, x in zip(*(c.to_pylist() for c in batch.columns)):
                    q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                    s = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(x).reshape(len(ids), -1).T
                    if not include_self:
                        s[q_ids[:, None] == ids[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 12)), axis=1)[:, :k]
                    row, column = np.repeat(np.arange(len(q_ids)), order.shape[1]), order.ravel()
                    ok = np.isfinite(s[row, column])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[ok]]), pa.array(ids[column[ok]]), pa.array(s[row, column][ok])], names=["query_id", "id", "score"])

        return met.mapInArrow(score, "query_id long, id long, score double")

    def rows(self) -> DataFrame:
        """Rows (query_id, id, score, rank), ties by id."""
        found = self.near.unionByName(self.scored(self.rest))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k)

    def share_read(self) -> float:
        """Of all pairs of packs and blocks, the share that was read."""
        pairs = self.packs.count() * self.n_blocks
        return (self.plan.where("first").count() + self.rest.count()) / max(pairs, 1)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries side by side, up to PACK of one size."""
    d, ids, rows = -1, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(rows)])], names=["d", "q_ids", "q"])

    for batch in batches:
        for size, _, id_, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if ids and (size != d or len(ids) == PACK):
                yield out()
                ids, rows = [], []
            d = size
            ids.append(id_)
            rows.append(x)
    if ids:
        yield out()


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [int(np.frombuffer(ids, np.int64)[row]) for row, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["pack", "row", "query_id"])


def nearest(queries: DataFrame, index: versions.Snapshot, k: int, id_col: str = "id", vector_col: str = "embedding", include_self: bool = False) -> DataFrame:
    """Rows (query_id, id, score, rank): the k vectors of the index nearest to each query, exactly, ties by id. Null and empty
    queries find nothing; vectors of another size than a query's aren't compared with it."""
    return Search(queries, index, k, id_col, vector_col, include_self).rows()

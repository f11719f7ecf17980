"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are one before anything is compared.  Unit vectors are rotated to their principal axes, so that leading
dimensions carry most of each product, and sorted into blocks along the first axis.  Two blocks form a tile: leading
dimensions are multiplied first; the rest of a product is at most the product of both vectors' suffix norms, and pairs
whose bound stays below the threshold go no further.  What survives all bounds is verified in double precision on the vectors
as they were, not on the rotated ones: whether two vectors are linked depends on nothing but them.  Neighbouring blocks are
dealt together, so that a task holds a square of tiles and a block is sent once for all tiles of a square.  A task returns,
per vector, the number of its links and one link into a spanning forest, which it keeps as links are found: never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.shared import components, join_split, staged

#: Shares of the dimensions after which products are bounded, and rows and columns multiplied at once.
STEPS, SUB = (0.25, 0.5), 2048
#: Pairs that are followed up at once.
CHUNK = 1 << 18
#: Slack of the bounds, which are taken in single precision.
SLACK = 1e-3
#: Leading axes of a block's bounding box.
BOX = 8
#: Bytes of a block at most, and blocks on a side of a square of tiles at most.
BLOCK_BYTES, SQUARE = 4 << 20, 8


def units(values: pa.Array) -> np.ndarray:
    """Unit vectors (rows) of a list array whose lists have one length.  Scaling by a power of two loses nothing."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def axes(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Principal axes (columns, strongest first) and number of the vectors in column ``v``, by sums over all rows.

    Only the d x d sums reach the driver, summed per partition and again by place.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(0))
                total = x.T @ x + (0 if total is None else total)
                n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s"])

    parts = vectors.select("v").mapInArrow(sums, "n long, s array<double>")
    rows = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    d = int(round(len(rows) ** 0.5))
    if not d:
        return np.zeros((0, 0)), 0
    moment = np.zeros(d * d)
    for r in rows:
        moment[r.pos] = r.s
    return np.linalg.eigh(moment.reshape(d, d))[1][:, ::-1].copy(), rows[0].n


class Block:
    """Unit vectors with their rotation in single precision and suffix norms after each step."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        self.unit = unit
        turned = unit @ turn
        d = turned.shape[1]
        self.cuts = sorted({max(1, min(d, round(d * s))) for s in STEPS})
        self.lead = turned.astype(np.float32)
        self.norms = [np.sqrt(np.maximum((turned[:, c:] ** 2).sum(axis=1), 0)).astype(np.float32) for c in self.cuts]

    def bounded(self, at: int) -> np.ndarray:
        """Leading dimensions of some rows, with the suffix norm as one more: products of these are the bounds."""
        return np.hstack([self.lead[at : at + SUB, : self.cuts[0]], self.norms[0][at : at + SUB, None]])


def tile(left: Block, right: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers of all pairs with a product of at least ``threshold``, in parts of at most ``CHUNK``."""
    for i in range(0, len(left.unit), SUB):
        a = left.bounded(i)
        for j in range(0, len(right.unit), SUB):
            bound = a @ right.bounded(j).T
            flat = np.flatnonzero(bound >= threshold - SLACK)
            for at in range(0, len(flat), CHUNK):
                p, q = np.divmod(flat[at : at + CHUNK], bound.shape[1])
                p, q = p + i, q + j
                for c, one, two in zip(left.cuts[1:], left.norms[1:], right.norms[1:]):
                    near = np.einsum("ij,ij->i", left.lead[p, :c], right.lead[q, :c]) + one[p] * two[q] >= threshold - SLACK
                    p, q = p[near], q[near]
                true = np.einsum("ij,ij->i", left.unit[p], right.unit[q]) >= threshold
                if true.any():
                    yield p[true], q[true]


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes (the smallest node reachable) with the links (a, b) added; ``label`` has the labels without them."""
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        while True:
            flat = new[new]
            if (flat == new).all():
                break
            new = flat
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own component.
    Vectors of different lengths don't link. Rows with equal vectors link with one another, the same id in several rows
    included; null ids are kept and name no component that has another id; an empty table gives an empty table; further
    columns are ignored.

    Comparing all blocks is quadratic in the number of distinct vectors where no bounding box keeps two blocks apart; a block
    has about ``block`` vectors at most (fewer of many dimensions), so memory is bounded, and squares of tiles are independent.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.when(usable, v).alias("v"))
    copies = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))

    distinct = staged(copies.withColumn("node", F.monotonically_increasing_id()), "distinct")
    lengths = [r.n for r in distinct.groupBy(F.size("v").alias("n")).agg(F.count("*")).collect()]  # the lengths of vectors that occur: few
    links = None
    for size in sorted(lengths):
        found = _links(distinct.where(F.size("v") == size), threshold, block)
        links = found if links is None else links.unionByName(found)
    if links is None:
        named = distinct.select("v", "copies", "first_id", F.lit(0).cast("long").alias("others"), F.col("node").alias("root"))
    else:
        links = staged(links, "links")
        counts = links.groupBy(F.col("a").alias("node_")).agg(F.sum("n").alias("others"))
        roots = components(links.where("a <> b").select("a", "b")).withColumnRenamed("node", "node__")
        named = distinct.join(counts, F.col("node") == F.col("node_"), "left").join(roots, F.col("node") == F.col("node__"), "left")
        named = named.select("v", "copies", "first_id", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "node").alias("root"))
    named = staged(named, "named")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component"))
    answers = join_split(named, ids, "root", named.count()).select(F.col("v").alias("v_"), (F.col("others") + F.col("copies") - 1).alias("links"), "component")
    out = rows.join(answers, F.col("v") == F.col("v_"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (a, b, n): node, a node it is connected with in a task, copies of the nodes it is linked with there."""
    spark = vectors.sparkSession
    turn, total = axes(vectors)
    size = max(1024, min(block, total // 8, BLOCK_BYTES // (8 * max(1, len(turn)))))
    lead = min(BOX, len(turn))
    first = turn[:, 0].copy()
    kind = vectors.schema["v"].dataType.simpleString()

    def position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # Many vectors may lie at one place along an axis, as those without it do: a millionth by node parts them.
                x = units(batch.column(2)) @ first + (batch.column(0).to_numpy() % 999_983) * 1e-12
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(x, pa.float64())], names=["node", "copies", "v", "x"])

    placed = vectors.select("node", "copies", "v").mapInArrow(position, f"node long, copies long, v {kind}, x double")
    n_blocks = -(-total // size)
    cuts = np.array(placed.approxQuantile("x", [i / n_blocks for i in range(1, n_blocks)], 0.1 / n_blocks)) if n_blocks > 1 else np.zeros(0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(3).to_numpy())), *(batch.column(i) for i in range(3))], names=["block", "node", "copies", "v"])

    item = np.float32 if kind == "array<float>" else np.float64
    d = len(turn)

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        number, values = rows.column("block")[0].as_py(), rows.column("v").chunk(0)
        x = units(values) @ turn[:, :lead]
        packed = [number, rows.column("node").to_numpy().tobytes(), rows.column("copies").to_numpy().tobytes(), values.flatten().to_numpy(zero_copy_only=False).astype(item).tobytes(), x.min(axis=0).tolist(), x.max(axis=0).tolist()]
        kinds = [("block", pa.int64()), ("nodes", pa.binary()), ("copies", pa.binary()), ("x", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]
        return pa.table({n: pa.array([v], k) for (n, k), v in zip(kinds, packed)})

    numbered = placed.mapInArrow(number, f"block long, node long, copies long, v {kind}")
    blocks = staged(numbered.groupBy("block").applyInArrow(gather, "block long, nodes binary, copies binary, x binary, lo array<double>, hi array<double>"), "blocks")
    # Vectors with a product of at least the threshold are no farther apart than this, along any axes. Boxes meet by cells of
    # the first axis; an own cell of one and the cells around the other.
    reach = (max(0.0, 2 - 2 * threshold) + SLACK) ** 0.5
    cell = [F.floor(F.col(c)[0] / reach) for c in ("lo", "hi")]
    one = blocks.select(F.col("block").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.sequence(*cell)).alias("cell"))
    two = blocks.select(F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(cell[0] - 1, cell[1] + 1)).alias("cell"))
    gaps = F.transform(F.arrays_zip("lo1", "hi1", "lo2", "hi2"), lambda z: F.greatest(F.lit(0.0), z["lo1"] - z["hi2"], z["lo2"] - z["hi1"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    meeting = one.join(two, "cell").where("i <= j").where(apart <= reach * reach).select("i", "j").distinct()
    # Squares of tiles: as large as leaves work for all tasks. Each has a list of its tiles and is sent each of its blocks once.
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, min(SQUARE, int(n_blocks / (2 * parallel) ** 0.5)))
    squares = meeting.withColumns({"p": F.expr(f"i div {side}"), "q": F.expr(f"j div {side}")})
    squares = staged(squares.groupBy("p", "q").agg(F.collect_list(F.struct("i", "j")).alias("tiles")), "squares")
    needed = squares.select("p", "q", "tiles", F.explode(F.array_distinct(F.concat("tiles.i", "tiles.j"))).alias("wanted"))
    loaded = needed.join(blocks.select("block", "nodes", "copies", "x"), F.col("wanted") == F.col("block")).select("p", "q", "tiles", "block", "nodes", "copies", "x")
    tasks = max(1, min(squares.count(), 4 * parallel))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        place = {b: k for k, b in enumerate(rows.column("block").to_pylist())}
        nodes, copies = ([np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()] for c in ("nodes", "copies"))
        start = np.cumsum([0, *map(len, nodes)])
        nodes, copies = np.concatenate(nodes), np.concatenate(copies)
        held: dict[int, Block] = {}

        def block_of(k: int) -> Block:
            if k not in held:
                flat = np.frombuffer(rows.column("x")[k].as_buffer(), item)
                held[k] = Block(units(pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, d, dtype=np.int32), flat)), turn)
            return held[k]

        count, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for t in sorted(rows.column("tiles")[0].as_py(), key=lambda t: (t["i"], t["j"])):
            i, j = place[t["i"]], place[t["j"]]
            for a, b in tile(block_of(i), block_of(j), threshold):
                a, b = a + start[i], b + start[j]
                if i == j:
                    a, b = a[a != b], b[a != b]
                else:
                    np.add.at(count, b, copies[a])
                np.add.at(count, a, copies[b])
                label = connect(label, a, b)
        hit = np.flatnonzero(count)
        return pa.table({"a": pa.array(nodes[hit]), "b": pa.array(nodes[label[hit]]), "n": pa.array(count[hit])})

    return loaded.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(compare, "a long, b long, n long")

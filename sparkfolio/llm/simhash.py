"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of 64 bits that differ in at most 4 agree in at least 4 of their 8 bytes.  Postings are keyed by three byte
positions and their bytes.  The 20 sets of three positions are chosen so that any four positions contain one of them, so
each pair to be found meets in a posting.  Postings of single positions (256 values each) would hold a 256th of all
fingerprints and more, and all their pairs; the tally of a pair's shared positional bytes is therefore taken from both
fingerprints where the pair meets, not from counts over postings: it is the same number.  Pairs below four shared bytes are
dropped, and the others are verified bit by bit.  A task keeps only a spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.shared import col, components, fresh, join_split, staged

SHINGLE_WORDS, SEED, MAX_BITS, BYTES = 4, 42, 4, 8


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE_WORDS:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the fingerprint's 64 bits as a signed long."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return df.select(col(id_col), col(text_col)).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("fp", T.LongType())]))


def triples() -> list[tuple[int, int, int]]:
    """Sets of three of the eight byte positions, one of which lies in any four: positions are dealt to three groups; three of
    one group, or two of a group with one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    return [t for t in combinations(range(BYTES), 3) if sorted(group[p] for p in t) in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2])]


def _links(keys, fps, sides):
    """Spanning forest, as two arrays, of the links between fingerprints that stand in one posting.

    Rows are sorted by key.  sides: 0 where all pairs of a posting meet; else pairs of side 1 with side 2 only.
    """
    import numpy as np

    nodes, where = np.unique(fps, return_inverse=True)
    label = np.arange(len(nodes))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    last = np.repeat(ends, np.diff(np.append(0, ends)))  # the end of each row's posting
    rows = np.arange(len(keys))
    bits = fps.view(np.uint64)
    step = 1
    while True:
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        a, b = rows, rows + step
        apart = bits[a] ^ bits[b]
        shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        enough = (shared >= BYTES - MAX_BITS) & ((sides[a] == 0) | (sides[a] != sides[b]))
        a, b, apart = a[enough], b[enough], apart[enough]
        near = np.bitwise_count(apart) <= MAX_BITS
        x, y = where[a[near]], where[b[near]]
        open_ = label[x] != label[y]
        if open_.any():
            for i, j in zip(x[open_].tolist(), y[open_].tolist()):
                i, j = root(i), root(j)
                if i != j:
                    label[max(i, j)] = min(i, j)
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat
        step += 1
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_links(fps: DataFrame, block: int = 8192) -> DataFrame:
    """Rows (a, b) of fingerprints that are linked, enough to connect all that are; from a column ``fp`` of distinct ones.

    A posting of more than ``block`` fingerprints is dealt to blocks, and each pair of blocks is a posting of its own.
    """
    keys = []
    for i, positions in enumerate(triples()):
        value = F.lit(i).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(value)
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = postings.groupBy("key").count().where(F.col("count") > block).select(F.col("key").alias("key_"), F.ceil(F.col("count") / block).cast("int").alias("n"))
    dealt = postings.join(large, F.col("key") == F.col("key_"), "left").drop("key_")
    whole = dealt.where("n is null").selectExpr("key", "cast(0 as int) as i", "cast(0 as int) as j", "fp", "cast(0 as byte) as side")
    own = dealt.where("n is not null").withColumn("own", F.expr("cast(pmod(hash(fp), n) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    parts = own.select("key", "own", other.alias("other"), "fp").selectExpr(
        "key", "least(own, other) as i", "greatest(own, other) as j", "fp", "cast(case when own = other then 0 when own < other then 1 else 2 end as byte) as side"
    )
    everything = whole.unionByName(parts).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size = [], 0

        def flush(rows):
            full = pa.Table.from_batches(rows)
            key, i, j = (full.column(c).to_numpy() for c in ("key", "i", "j"))
            new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            a, b = _links(np.cumsum(new), full.column("fp").to_numpy().copy(), full.column("side").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def ends(batch):
            """Row from which a batch's last posting runs."""
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 500_000 and (at := ends(batch)):  # a posting is never cut
                held[-1] = batch.slice(0, at)
                yield flush(held)
                held, size = [batch.slice(at)], batch.num_rows - at
        if held:
            yield flush(held)

    return everything.mapInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id), one per row of ``df``: component_id is the smallest id reachable over linked fingerprints.

    A null or empty text, or one of white space, has fingerprint 0 and is linked like any other; texts of fewer than four
    words are one shingle; null ids are kept but never name a component, unless it has no other id (then it is null);
    repeated rows share a fingerprint and so a component; an empty table gives an empty table; further columns are ignored.
    Copies meet in their fingerprint, so pairs are sought between distinct fingerprints only.
    """
    return _classes(staged(fingerprints(df, id_col, text_col), "fingerprints"), id_col)


def _classes(prints: DataFrame, id_col: str) -> DataFrame:
    """Fingerprints (id, fp) with their components."""
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    named = staged(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "named")
    total = named.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = staged(join_split(named, ids, "root", total.n).select("fp", "component_id"), "classes")
    return join_split(prints, classes, "fp", total.rows).select(id_col, "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that name their component: one document of each group. Rows equal in id and text stay once.

    A null id names a component only where no other id does.  Texts are dealt by id once; only if ids repeat are they dealt
    again, to drop repeated rows.
    """
    prints = staged(fingerprints(df, id_col, text_col), "fingerprints")
    classes = staged(_classes(prints, id_col), "classes")
    name = fresh(df, "kept")
    named = classes.where(col(id_col) == F.col("component_id")).select(col(id_col).alias(name)).distinct()
    kept = df.join(named, col(id_col) == F.col(name), "left_semi")
    if classes.where(F.col("component_id").isNull()).head(1):
        kept = kept.unionByName(_of_null_ids(df, classes, id_col, text_col))
    if prints.groupBy(id_col).count().where("count > 1").head(1):
        kept = kept.dropDuplicates([id_col, text_col])
    return kept


def _of_null_ids(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of components without any id, the rows of the least text."""
    lonely = classes.where(F.col("component_id").isNull()).select("fp").distinct()
    rows = df.where(col(id_col).isNull())
    marked = fingerprints(rows.select(col(text_col).alias("of"), col(text_col).alias("text")), "of", "text").join(lonely, "fp", "left_semi")
    roots = components(near_links(lonely))
    least = fresh(df, "least")
    placed = marked.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.coalesce("of", F.lit(""))).alias(least))
    return rows.join(placed.select(least).distinct(), F.coalesce(col(text_col), F.lit("")) == F.col(least), "left_semi").dropDuplicates([text_col])

"""Pieces that several operators of this subpackage use: the shared folder, staged tables, word splitting, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import stage_path

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has: ``name``, with underscores after it as long as one has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_split(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with the rows of a table that has few per key (inner).  total: the number of rows.

    A key with more than a 200th of all rows, and more than 500, would be one long task; there are fewer than 200 such keys,
    whatever the table's size: their rows of the table are broadcast, and their own rows stay where they are.
    """
    limit = max(500, total // 200)
    hot = [r[0] for r in rows.groupBy(key).count().where((F.col("count") > limit) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table, key).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as rows (node, root): root is the smallest node reachable. Nodes without an edge don't appear.

    Alternating large-star and small-star rounds. Each round is two grouped minima (summed before the shuffle) joined
    back to the edges, written to the shared folder; rounds go on until nothing changes, and their number grows with the
    logarithm of the longest path.  Only a count and a hash of the edges, and nodes with very many neighbours, of which there
    are fewer than 200, reach the driver.
    """

    def star(pairs: DataFrame, total: int) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return join_split(pairs, low, "u", total)

    def mark(pairs: DataFrame) -> tuple[int, int]:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = mark(e)
    while last[0]:
        # Large star: every neighbour above u moves to the smallest node around u, u included.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, 2 * last[0]).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v")
        # ... keeps v > old u only; the pairs with v < u come again from the other direction.
        large = large.distinct()
        # Small star: what lies below u, and u itself, moves to the smallest of them.
        small = star(large, last[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = staged(small.where("u > v").distinct(), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()

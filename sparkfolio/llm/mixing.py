"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; running sums over a source's buckets give the one bucket in which its budget
ends; only that bucket's documents are summed again, by finer buckets, and the last few rows one by one.  The result is a
threshold of the hash per source: documents up to it are taken once more than the source's whole copies.  Thresholds are
nested: a larger budget takes a superset.  Nothing sorts or moves the documents; the sums are made before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.shared import col, fresh, staged, word_count

#: Bits of the hash: the first 12 hexadecimal digits of the id's MD5. Each level of buckets takes 12 of them.
HASH_BITS, LEVEL_BITS = 48, 12


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    All targets add up to all sizes; a target stops at ``cap`` times its source's size and what is above goes to the others
    by weight, until none is above.  In closed form: by rising ratio of cap to weight, a source is capped if the share that
    is left for it and all after it would exceed its cap.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    ordered = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    )
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), "source", "level"))).over(everything)["level"]
    return shared.withColumn("free", free).select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def _boundary(sums: DataFrame) -> DataFrame:
    """Per source, the bucket in which the budget ends, and what is left of the budget at its start."""
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    crossing = sums.withColumn("upto", running).where(F.col("upto") > F.col("budget"))
    first = F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("words")).alias("left")))
    return crossing.groupBy("source").agg(first.alias("f")).select("source", F.col("f.bucket").alias("bucket"), F.col("f.left").alias("budget"))


def _with_source(rows: DataFrame, table: DataFrame, how: str = "inner", source: str = "source") -> DataFrame:
    """Rows with their source's row of a table, whose size decides whether it is broadcast; otherwise adaptive execution splits
    a hot source's rows."""
    other = fresh(rows, "source_")
    return rows.join(table.withColumnRenamed("source", other), col(source).eqNullSafe(F.col(other)), how).drop(other)


def _digest(id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def _taken(docs: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Rows (source, source_size, target, copies, budget, start, last), one per source, from rows (id, source, size, h): a
    document is taken ``copies`` times, and once more as ``_times`` says."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = staged(
        targets(sizes, weights, cap)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")),
        "targets",
    )
    rows, end = docs.where("size > 0"), plan.select("source", "budget")
    for bits in range(HASH_BITS - LEVEL_BITS, HASH_BITS - 3 * LEVEL_BITS, -LEVEL_BITS):
        sums = rows.groupBy("source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("words"))
        found = staged(_boundary(_with_source(sums, end)), "bucket")
        rows = _with_source(rows, found.select("source", "bucket")).where(F.shiftright("h", bits) == F.col("bucket")).drop("bucket")
        end = found.select("source", "budget")
    alike = rows.groupBy("source", "h", "id", "size").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("h", "id", "size"))
    last = _with_source(alike, end).withColumn("before", upto - F.col("words")).where(2 * F.col("before") + F.col("words") <= 2 * F.col("budget"))
    last = last.groupBy("source").agg(F.max(F.struct("h", "id", "size")).alias("last"))
    # A source whose budget ends in no bucket is taken whole; one without a document up to its budget in the last bucket
    # is taken up to that bucket's start.
    start = F.shiftleft("bucket", HASH_BITS - 2 * LEVEL_BITS)
    ends = _with_source(found.select("source", start.alias("start")), last, "left")
    return staged(_with_source(plan, ends, "left"), "thresholds")


def _times(h: str, id_col: str, size: str) -> Column:
    """How often a document is taken."""
    place = F.struct(col(h).alias("h"), col(id_col).alias("id"), col(size).alias("size"))
    once_more = F.when(F.col("start").isNull(), F.col("budget") > 0).otherwise((col(h) < F.col("start")) | (place <= F.col("last")))
    return F.col("copies") + F.coalesce(once_more, F.lit(False)).cast("long")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return staged(df.select(col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), _digest(id_col).alias("h")), "sizes")


def mix(df: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, size, source_size, target, taken), one per row of ``df``.

    Sources in code point order, null last, get the weights in turn.  A document is taken as often as its source's whole
    copies say, and once more if its hash lies up to the source's threshold; the document on which the budget ends is in if
    that comes nearer.  Null and empty texts have size 0 and are taken 0 words; rows that agree in id and size share their
    fate; null ids hash as the empty string; a null source is a source; an empty table gives an empty table; further columns
    are ignored.
    """
    docs = _sized(df, id_col, text_col, source_col)
    taken = F.col("size") * _times("h", "id", "size")
    return _with_source(docs, _taken(docs, weights, cap)).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with the columns of ``df``: a document taken several times appears so often.

    The thresholds decide where a document stands: texts are filtered and repeated, and never sorted or dealt by id.
    """
    thresholds = _taken(_sized(df, id_col, text_col, source_col), weights, cap)
    # The columns of df stand in one struct while the thresholds' names are about.
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), _digest(id_col).alias("h"))
    taken = _with_source(rows.where("size > 0"), thresholds).withColumn("times", _times("h", "id", "size").cast("int")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")

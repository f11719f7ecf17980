"""Line dedup by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.shared import col, fresh, staged

BLANK = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _key(bare: Column) -> Column:
    """96 bits that stand for a line without its outer white space."""
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def boilerplate_lines(df: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """Rows (host, keys): of lines that more than ``max_ratio`` of a host's pages, and at least ``min_pages``, contain.

    A host has at most (distinct lines per page) / max_ratio such lines, whatever its size, so one row holds them: ``keys`` has as many
    buckets as keys, each a short array, so that a line looks into one bucket instead of comparing itself with all keys.
    """
    # A page's lines are told apart as strings, by a hash set; keys, as structs, would be compared each with each.
    lines = F.array_distinct(F.filter(F.transform(F.split(col(text_col), "\n"), _bare), lambda x: x != ""))
    seen = df.select(col(host_col).alias("host"), F.explode(F.transform(lines, _key)).alias("key"))
    pages = seen.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = df.groupBy(col(host_col).alias("host_")).agg(F.count("*").alias("total"))
    often = pages.join(totals, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("pages") > max_ratio * F.col("total")).select("host", "key")
    often = staged(often, "boilerplate-keys")
    sizes = often.groupBy(F.col("host").alias("host_")).agg(F.count("*").alias("n"))
    placed = often.join(sizes, F.col("host").eqNullSafe(F.col("host_"))).select("host", F.pmod("key.a", F.col("n")).alias("at"), "key")
    empty = sizes.select(F.col("host_").alias("host"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"), F.lit(None).cast(often.schema["key"].dataType).alias("key"))
    buckets = placed.unionByName(empty).groupBy("host", "at").agg(F.collect_list("key").alias("some"))  # nulls aren't collected
    return buckets.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "some"))), lambda b: b["some"]).alias("keys"))


def _listed(keys: Column, bare: Column) -> Column:
    """Whether a line's key stands in its bucket."""
    return F.array_contains(F.get(keys, F.pmod(F.xxhash64(bare), F.size(keys)).cast("int")), _key(bare))


def drop_boilerplate(df: DataFrame, max_ratio: float = 0.05, min_pages: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with their boilerplate lines removed, and columns ``n_lines`` and ``n_dropped`` (long) after its own.

    Lines are split at \\n and compared without outer white space; blank lines stay.  A null text stays null and has no
    lines; it counts as a page of its host.  A null host is a host.  A line that a page repeats counts once for the page and
    is removed each time.  An empty table gives an empty table; other columns, whatever their names, are carried along, but
    ``n_lines`` and ``n_dropped`` of the input, which are replaced.  Only hashes of lines are shuffled, counted before the
    shuffle; texts move only if the hosts' table is too large for Spark to broadcast, and then adaptive execution splits a
    hot host's pages.
    """
    # Written first: the join is planned with the table's size known, so that pages aren't dealt by host to find it small.
    table = staged(boilerplate_lines(df, host_col, text_col, max_ratio, min_pages), "boilerplate")
    host, keys, kept = (fresh(df, name) for name in ("host", "keys", "kept"))
    joined = df.join(table.select(F.col("host").alias(host), F.col("keys").alias(keys)), col(host_col).eqNullSafe(F.col(host)), "left")
    lines = F.split(col(text_col), "\n")
    rest = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, lambda x: ~_listed(F.col(keys), _bare(x))))
    rows = joined.withColumn(kept, rest)
    return rows.select(
        *[F.array_join(kept, "\n").alias(c) if c == text_col else col(c) for c in df.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.coalesce(F.when(col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(col(text_col).isNotNull(), F.size(lines) - F.size(kept)), F.lit(0)).cast("long").alias("n_dropped"),
    )

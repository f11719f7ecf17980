"""Set operations and upserts as whole-table rewrites: old and new rows in, the table after the change out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: Sequence[str], left: str = "o", right: str = "n"):
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is new; of new rows with one key the first in column order."""
    fresh = new.alias("o").join(old.select(*keys).alias("n"), _same(keys), "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))
    return old.unionByName(fresh.withColumn("_r", rank).where("_r = 1").drop("_r").select(*old.columns))


def insert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and old ones whose key isn't among them."""
    return old.alias("o").join(new.select(*keys).alias("n"), _same(keys), "left_anti").unionByName(new.select(*old.columns))


def newest_wins(keep: DataFrame, other: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """One row per key, the one with the later clock; on equal clocks the row of ``keep``."""
    both = keep.withColumn("_side", F.lit(1)).unionByName(other.withColumn("_side", F.lit(0)))
    values = [c for c in keep.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(clock, "_side")).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in values]).select(*keep.columns)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns take the change's value where it has one; rows without a change stay."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = old.join(c, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])


def patch_titles(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """As ``patch`` for title; a changed title is from then on the user's."""
    c = changes.where("title is not null").select(F.col("id").alias("_id"), F.col("title").alias("_title"))
    joined = papers.join(c, F.col("id") == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_title", "title").alias("title") if x == "title" else F.when(F.col("_title").isNotNull(), "user").otherwise(F.col("title_source")).alias(x) if x == "title_source" else F.col(x) for x in papers.columns])


def detected_titles(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Titles found in files: never over a user's, never empty, and nothing changes if they are equal."""
    c = found.select(F.col("id").alias("_id"), F.trim("title").alias("_title"))
    joined = papers.join(c, F.col("id") == F.col("_id"), "left")
    takes = F.coalesce((F.col("title_source") != "user") & (F.col("_title") != "") & (F.col("_title") != F.col("title")), F.lit(False))
    return joined.select(*[F.when(takes, F.col("_title")).otherwise(F.col("title")).alias("title") if x == "title" else F.when(takes, "detected").otherwise(F.col("title_source")).alias(x) if x == "title_source" else F.col(x) for x in papers.columns])


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, DataFrame]:
    """Tables without rows that name a deleted id in any of the given columns."""
    out = {}
    for name, (table, columns) in tables.items():
        for c in columns:
            table = table.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti").select(*table.columns)
        out[name] = table
    return out


def recolor_highlights(highlights: DataFrame, changes: DataFrame) -> DataFrame:
    """A colour set on one highlight (id, color) holds for all rows of its group."""
    key = F.coalesce("group_key", "id")
    c = changes.withColumnRenamed("color", "_color").join(highlights.select("id", key.alias("_key")), "id").groupBy("_key").agg(F.max("_color").alias("_color"))
    joined = highlights.withColumn("_k", key).join(c, F.col("_k") == F.col("_key"), "left")
    return joined.select(*[F.coalesce("_color", "color").alias("color") if x == "color" else F.col(x) for x in highlights.columns])


def delete_highlights(highlights: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the groups that the given rows belong to."""
    key = F.coalesce("group_key", "id")
    gone = highlights.join(ids.select("id"), "id", "left_semi").select(key.alias("_key")).distinct()
    return highlights.withColumn("_key", key).join(gone, "_key", "left_anti").select(*highlights.columns)


def save_highlights(selections: DataFrame) -> DataFrame:
    """A row per page of a selection (selection_id, pages array); they share a key only if there is more than one page."""
    rows = selections.select("selection_id", F.size("pages").alias("n"), F.explode("pages").alias("page_number"))
    return rows.select("selection_id", "page_number", F.when(F.col("n") > 1, F.col("selection_id").cast("string")).alias("group_key"))


def fold_duplicates(notes: DataFrame, memberships: DataFrame, merged: DataFrame, clock: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """Notes and memberships of duplicate tags moved to those that are kept (tag_id, keep_id): newer notes win."""
    moved = notes.join(merged, "tag_id")
    keep, other = [moved.where(c).select(F.col("keep_id").alias("tag_id"), *[c for c in notes.columns if c != "tag_id"]).select(*notes.columns) for c in ("tag_id = keep_id", "tag_id <> keep_id")]
    return newest_wins(keep, other, ["tag_id", "paper_id"], clock), memberships.join(merged, "tag_id").select(F.col("keep_id").alias("tag_id"), "paper_id").distinct()

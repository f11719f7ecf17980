"""Library views: filters, joins and aggregates over papers, groups and tags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import ascii_lower, normalize_tag

# States of a paper that is being worked on, and colours of highlights.
PROCESSING = ("copying", "extracting", "indexing", "waiting_for_ai", "analyzing")
SETTLED = ("ready", "partial", "failed")
COLORS = ("yellow", "green", "blue", "pink", "purple")


@dataclass(frozen=True)
class LibraryQuery:
    """Conjunctive, all optional. ``tags`` must all be on a paper; a null year fails a year bound."""

    view: str | None = None
    group: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    year_from: int | None = None
    year_to: int | None = None
    status: str | None = None
    sort: str = "recent"


def with_metadata(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    return papers.join(metadata.withColumnRenamed("paper_id", "_paper"), F.col("id") == F.col("_paper"), "left").drop("_paper")


def has_all_tags(paper_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Papers that carry every tag, by division: one shuffle whatever the number of tags. Tags that differ only in case or white
    space are one, among those asked for as on a paper."""
    asked = {" ".join(t.split()).lower() for t in tags}
    held = paper_tags.select("paper_id", normalize_tag(F.col("tag")).alias("tag")).where(F.col("tag").isin(sorted(asked)))
    return held.groupBy("paper_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(asked)).select("paper_id")


def orders(sort: str) -> list[Column]:
    return {
        "title": [ascii_lower(F.col("title")).asc(), F.col("id").asc()],
        "year": [F.col("year").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()],
        "opened": [F.col("last_opened_at").desc_nulls_last(), F.col("id").asc()],
    }.get(sort, [F.col("created_at").desc(), F.col("id").asc()])


def existing_tags(tags: DataFrame, most: int = 100) -> DataFrame:
    """The first tags (tag) by name without regard to ASCII case, as many as a prompt shows."""
    return tags.select("tag").distinct().orderBy(ascii_lower(F.col("tag")), "tag").limit(most)


def placed(papers: DataFrame, sort: str) -> DataFrame:
    """Papers with their ``place`` in the list, from 1.

    Papers are dealt by a coarse form of the sort's first key, whose histogram gives how many stand before each part; a part
    is ranked by itself, so no task ranks the whole list.
    """
    coarse, falls = {
        "title": (F.substring(ascii_lower(F.col("title")), 1, 4), False),
        "year": (F.col("year"), True),
        "opened": (F.floor(F.col("last_opened_at") / 1000), True),
    }.get(sort, (F.floor(F.col("created_at") / 1000), True))
    rows = papers.withColumn("_part", coarse)
    order = F.col("_part").desc_nulls_last() if falls else F.col("_part").asc_nulls_first()
    before = F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select(F.col("_part").alias("_of"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*orders(sort)))
    return rows.join(parts, F.col("_part").eqNullSafe(F.col("_of"))).withColumn("place", F.col("_before") + own).drop("_part", "_of", "_before")


def list_papers(papers: DataFrame, metadata: DataFrame, paper_groups: DataFrame, paper_tags: DataFrame, query: LibraryQuery, matching: DataFrame | None = None, attach: bool = False) -> DataFrame:
    """The library list. matching: papers (column id) that a keyword search found. attach: arrays of groups and tags."""
    out = with_metadata(papers, metadata)
    if query.view == "favorites":
        out = out.where("is_favorite")
    elif query.view == "inbox":
        out = out.join(paper_groups.select(F.col("paper_id").alias("id")), "id", "left_anti")
    elif query.view == "processing":
        out = out.where(F.col("status").isin(*PROCESSING))
    elif query.view == "failed":
        out = out.where("status = 'failed'")
    if query.group is not None:
        out = out.join(paper_groups.where(F.col("group_id") == query.group).select(F.col("paper_id").alias("id")), "id", "left_semi")
    if query.tags:
        out = out.join(has_all_tags(paper_tags, query.tags).withColumnRenamed("paper_id", "id"), "id", "left_semi")
    if query.year_from is not None:
        out = out.where(F.col("year") >= query.year_from)
    if query.year_to is not None:
        out = out.where(F.col("year") <= query.year_to)
    if query.status is not None:
        out = out.where(F.col("status") == query.status)
    if matching is not None:
        out = out.join(matching.select("id").distinct(), "id", "left_semi")
    if attach:
        groups = paper_groups.groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("group_id")).alias("groups"))
        tags = paper_tags.groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        out = out.join(groups, "id", "left").join(tags, "id", "left")
        out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("groups", "tags")})
    return out.orderBy(*orders(query.sort))


def group_counts(groups: DataFrame, paper_groups: DataFrame) -> DataFrame:
    """Papers per group; groups without papers count 0."""
    counts = paper_groups.groupBy(F.col("group_id").alias("_g")).agg(F.count("*").alias("n"))
    return groups.join(counts, F.col("group_id") == F.col("_g"), "left").select("group_id", F.coalesce("n", F.lit(0)).cast("long").alias("paper_count"))


def next_sort_order(groups: DataFrame) -> DataFrame:
    return groups.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).cast("long").alias("sort_order"))


def has_text_layer(pages: DataFrame, least: int = 200) -> DataFrame:
    total = F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).cast("long")
    return pages.groupBy("paper_id").agg(total.alias("n_chars")).withColumn("has_text", F.col("n_chars") > least)


def orphans_pruned(child: DataFrame, papers: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ends all name a paper."""
    for c in columns:
        child = child.join(papers.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    return child


def settled_without_job(papers: DataFrame, jobs: DataFrame, kind: str, version: str) -> DataFrame:
    """Settled papers that no job of this kind and version was made for."""
    key = F.concat_ws(":", F.col("id").cast("string"), F.lit(kind), F.lit(version))
    return papers.where(F.col("status").isin(*SETTLED)).withColumn("key", key).join(jobs.select(F.col("idempotency_key").alias("key")), "key", "left_anti")


def one_per_highlight(highlights: DataFrame) -> DataFrame:
    """A row per logical highlight: the first of each group key by page and time."""
    key = F.coalesce("group_key", "id")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("page_number", "created_at", "id"))
    return highlights.withColumn("_key", key).withColumn("_rank", rank).where("_rank = 1").drop("_key", "_rank")


def last_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n complete messages with text of each session, with their place from 1 in time order; of equal times the
    user's comes first."""
    late = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.when(F.col("role") == "user", 1).otherwise(0), F.col("message_id").desc())
    kept = messages.where(F.trim("content") != "").withColumn("back", F.row_number().over(late)).where(F.col("back") <= n)
    return kept.withColumn("place", F.count("*").over(Window.partitionBy("session_id")) - F.col("back") + 1).drop("back")


def numbered_highlights(highlights: DataFrame, least_bytes: int = 2) -> DataFrame:
    """Per paper, the text of its highlights as a numbered list for a summary."""
    kept = highlights.where(F.octet_length(F.trim("selected_text")) > least_bytes)
    no = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "created_at", "id"))
    line = F.concat(F.col("no").cast("string"), F.lit(". "), F.trim("selected_text"))
    ordered = kept.withColumn("no", no).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("no", line.alias("line")))).alias("lines"))
    return ordered.select("paper_id", F.array_join("lines.line", "\n").alias("source"))

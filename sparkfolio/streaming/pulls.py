"""Edited notes pulled from a vault as a stream: each batch is one commit, and is applied once though it comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.operators import notes
from sparkfolio.sources import versions
from sparkfolio.sources.versions import Change

#: Tables of a library that pulls change, each with the column by which its rows are replaced.
TABLES = {"papers": "paper_id", "groups": "name", "paper_groups": "paper_id", "paper_tags": "paper_id", "sync": "paper_id", "batches": "stream"}
SYNC = "paper_id string, path string, revision string, status string"


def library(spark: SparkSession, root: str, papers: DataFrame, groups: DataFrame, sync: DataFrame) -> versions.Snapshot:
    """A new library: papers (paper_id), groups (name), and what is known of their notes (SYNC); no memberships or tags yet."""
    members = spark.createDataFrame([], "paper_id string, name string")
    tags = spark.createDataFrame([], "paper_id string, tag string")
    first = {"papers": papers.select("paper_id"), "groups": groups.select("name"), "paper_groups": members, "paper_tags": tags, "sync": sync, "batches": spark.createDataFrame([], "stream string, batch long")}
    return versions.commit(versions.opened(spark, root), {name: Change(TABLES[name], rows, everything=True) for name, rows in first.items()})


def pull(changed: DataFrame, batch: int, root: str, stream: str = "vault", marks: notes.Markers = notes.Markers()) -> bool:
    """Applies a batch of changed notes (path, content, at); whether it did, False where this batch was applied before.

    Of a path's changes the last counts, and of several notes that name one paper the last by ``at`` and path.  The paper's groups and tags
    become the note's; groups that don't exist are made; the paper is in sync with the note's content.  A damaged note
    changes nothing but the state of the paper whose note it is, to ``conflict``.  Notes without an id, of papers that
    don't exist, and null contents (a note that is gone) change nothing: a paper outlives its note.

    All of it, and the batch's number, is one commit: a batch that failed halfway left nothing, and one that is sent again, as
    a stream does after a failure, finds its number and is left alone.
    """
    spark = changed.sparkSession
    base = versions.opened(spark, root)
    done = base.table("batches").where(F.col("stream") == stream).agg(F.max("batch")).first()[0]
    if done is not None and batch <= done:
        return False
    last = Window.partitionBy("path").orderBy(F.col("at").desc(), F.xxhash64("content"))
    latest = changed.where("content is not null").withColumn("n", F.row_number().over(last)).where("n = 1").select("path", "content", "at")
    parsed = notes.parsed_notes(latest, marks=marks).join(latest.select("path", "at", F.sha2(F.col("content").cast("binary"), 256).alias("revision")), "path")
    known = base.table("papers").select(F.col("paper_id").alias("id"))
    of_paper = Window.partitionBy("id").orderBy(F.col("at").desc(), F.col("path").desc())
    good = parsed.where("error is null and id is not null").join(known, "id", "left_semi").withColumn("n", F.row_number().over(of_paper)).where("n = 1").drop("n")
    out = notes.pulled(good, base.table("groups"))
    synced = good.select(F.col("id").alias("paper_id"), "path", "revision", F.lit("synced").alias("status"))
    damaged = parsed.where("error is not null").select("path", F.col("revision").alias("now"))
    conflicts = base.table("sync").join(damaged, "path").join(out["synced"], "paper_id", "left_anti").select("paper_id", "path", F.col("now").alias("revision"), F.lit("conflict").alias("status"))
    changes = {
        "groups": Change("name", out["new_groups"]),
        "paper_groups": Change("paper_id", out["paper_groups"].select("paper_id", "name"), out["synced"]),
        "paper_tags": Change("paper_id", out["paper_tags"], out["synced"]),
        "sync": Change("paper_id", synced.unionByName(conflicts)),
        "batches": Change("stream", spark.createDataFrame([(stream, batch)], "stream string, batch long")),
    }
    versions.commit(base, changes)
    return True


def puller(root: str, stream: str = "vault", marks: notes.Markers = notes.Markers()) -> Callable[[DataFrame, int], None]:
    """What a stream of changed notes hands its batches to: ``writeStream.foreachBatch(puller(root))``."""

    def apply(changed: DataFrame, batch: int) -> None:
        changed = changed.persist()  # read by several of the commit's tables
        try:
            pull(changed, batch, root, stream, marks)
        finally:
            changed.unpersist()

    return apply

"""File import: validation, content hash, outcomes of a batch; and the sinks of extracted pages and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import rect_valid, title_from_file_name, usable_rects

TAIL, CRYPT_TAIL = 1024, 64 * 1024


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def rejection(content: Column) -> Column:
    """Why a file is no usable PDF, in the order of the checks, or null."""
    text = F.decode(content, "ISO-8859-1")
    end = F.substring(text, -TAIL, TAIL)
    return (
        F.when(content.isNull(), "unreadable")
        .when(F.octet_length(content) == 0, "empty")
        .when(~F.startswith(text, F.lit("%PDF-")), "signature")
        .when(~F.contains(end, F.lit("%%EOF")), "truncated")
        .when(F.contains(F.substring(text, -CRYPT_TAIL, CRYPT_TAIL), F.lit("/Encrypt")), "encrypted")
    )


def outcomes(files: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows (path, sha256, title, outcome, reason, paper_id): imported, duplicate (of a paper, or of an earlier file of the
    batch) or rejected. paper_id is the known paper's, else the hash stands for the new one."""
    f = files.withColumn("reason", rejection(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    known = papers.select(F.col("sha256").alias("_sha"), F.col("id").cast("string").alias("_id"))
    nth = F.row_number().over(Window.partitionBy("sha256", F.col("reason").isNull()).orderBy("path"))
    f = f.select("path", "sha256", "reason").withColumn("nth", nth).join(known, F.col("sha256") == F.col("_sha"), "left")
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_id").isNotNull() | (F.col("nth") > 1), "duplicate").otherwise("imported")
    return f.select("path", "sha256", title_from_file_name(F.col("path")).alias("title"), outcome.alias("outcome"), "reason", F.when(F.col("reason").isNull(), F.coalesce("_id", "sha256")).alias("paper_id"))


def copied(files: DataFrame, report: DataFrame, folder: str) -> DataFrame:
    """Rows (path, target, bytes): files that were imported, copied below a folder under their hash, whole or not at all; a copy
    that is there already stays. Lazy: an action on the result copies."""
    wanted = report.where("outcome = 'imported'").select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "sha256", F.lit(".pdf")).alias("target"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        for batch in batches:
            sizes = []
            for target, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, place = fs.FileSystem.from_uri(target)
                if system.get_file_info(place).type == fs.FileType.NotFound:
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    draft = f"{place}.{uuid4().hex}"
                    with system.open_output_stream(draft) as out:
                        out.write(content)
                    system.move(draft, place)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["path", "target", "bytes"])

    return wanted.join(files.select("path", "content"), "path").select("path", "target", "content").mapInArrow(write, "path string, target string, bytes long")


def inserted(papers: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    """Papers with the imported files as new ones, in the state that importing begins with."""
    new = report.where("outcome = 'imported'").select(F.col("paper_id").alias("id"), "sha256", "title", F.lit("file").alias("title_source"), F.lit("copying").alias("status"), now.alias("created_at"))
    return papers.unionByName(new.select(*[F.col(c).cast(papers.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(papers.schema[c].dataType).alias(c) for c in papers.columns]))


def to_enqueue(report: DataFrame) -> DataFrame:
    return report.where("outcome = 'imported'").select("paper_id", F.explode(F.array(F.lit("extract"), F.lit("thumbnail"))).alias("kind"))


def memberships(report: DataFrame, group_id: str) -> DataFrame:
    """Imported files and duplicates alike join the group they were dropped on."""
    return report.where("outcome <> 'rejected'").select("paper_id", F.lit(group_id).alias("group_id")).distinct()


def usable_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences with their rectangles clamped to the page; those of which none is left are dropped."""
    return sentences.withColumn("rects", usable_rects(F.col("rects"))).where(F.size("rects") > 0)


def all_valid(rects: Column) -> Column:
    return F.forall(rects, lambda r: rect_valid(r))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes rows so that exactly the partitions that they name are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

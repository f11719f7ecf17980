"""Small joins and projections around papers, notes, highlights and chats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import ascii_lower
from sparkfolio.operators.layout import split_around
from sparkfolio.operators.library import COLORS


def by_key(df: DataFrame, **keys) -> DataFrame:
    """The row with the given key, or none; the filter reaches the scan."""
    for k, v in keys.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df.limit(1)


def page_sentences(sentences: DataFrame, paper_id, page_number: int) -> DataFrame:
    return sentences.where((F.col("paper_id") == paper_id) & (F.col("page_number") == page_number)).orderBy("order_index")


def checked_colors(highlights: DataFrame) -> DataFrame:
    """Highlights with ``rejected``: a colour that isn't on the list."""
    return highlights.withColumn("rejected", ~F.coalesce(F.col("color").isin(*COLORS), F.lit(False)))


def related_titles(relations: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows (source, titles): titles of related papers, the best score first, those without a score last."""
    titled = relations.join(papers.select(F.col("id").alias("target"), "title"), "target")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("k"), "title")))
    return titled.groupBy("source").agg(F.transform(ordered, lambda x: x["title"]).alias("titles"))


def add_manual(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations with edges (source, target) drawn by hand, each once; a paper isn't related to itself."""
    new = edges.where("source <> target").select("source", "target", F.lit("manual").alias("relation_type"), F.lit(None).cast("double").alias("score")).distinct()
    return remove_manual(relations, edges).unionByName(new)


def remove_manual(relations: DataFrame, edges: DataFrame) -> DataFrame:
    gone = edges.select("source", "target", F.lit("manual").alias("relation_type")).distinct()
    return relations.join(gone, ["source", "target", "relation_type"], "left_anti").select("source", "target", "relation_type", "score")


def tag_notes(entries: DataFrame, tags: DataFrame, papers: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (tag_id, paper_id, insight, updated_at) of tags with the given labels in any ASCII case, with titles; place 1 is
    the newest."""
    wanted = labels.select("label", ascii_lower(F.col("label")).alias("_k")).join(tags.select("tag_id", ascii_lower(F.col("label")).alias("_k")), "_k")
    rows = entries.join(wanted, "tag_id").join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.col("updated_at").desc(), "tag_id", "paper_id"))).drop("_k")


def rects_of(selections: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows (selection_id, rects): rectangles of a selection's sentences (ids array), in its order."""
    named = selections.select("selection_id", F.posexplode("sentence_ids").alias("at", "id")).join(sentences.select("id", "rects"), "id")
    ordered = F.sort_array(F.collect_list(F.struct("at", "rects")))
    return named.groupBy("selection_id").agg(F.flatten(F.transform(ordered, lambda x: x["rects"])).alias("rects"))


def without_word(highlights: DataFrame, word: Column) -> DataFrame:
    """Highlights (id, rects) with a word cut out: unchanged parts stay one highlight, parts on both sides become two, and one
    of which nothing is left goes."""
    before, after = split_around(F.col("rects"), word)
    parts = F.filter(F.array(before, after), lambda p: F.size(p) > 0)
    return highlights.select("id", F.posexplode(parts).alias("part", "rects"))


def sync_list(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Sync records (paper_id, vault_path, status, updated_at) with their papers' titles; those of papers that are gone are not
    listed. The list is shown by ``updated_at``, newest first."""
    return records.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id").select("paper_id", "paper_title", "vault_path", "status", "updated_at")


def with_citations(messages: DataFrame, citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Messages (message_id, ...) with ``citations``: their sources (chunk_id, paper_id, paper_title, page_start, page_end) in the
    order of ``place``, without those of papers that are gone; empty where a message cites nothing."""
    titled = citations.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id")
    source = F.struct("place", F.struct("chunk_id", "paper_id", "paper_title", "page_start", "page_end").alias("c"))
    cited = titled.groupBy("message_id").agg(F.transform(F.sort_array(F.collect_list(source)), lambda x: x["c"]).alias("citations"))
    out = messages.join(cited, "message_id", "left")
    kind = cited.schema["citations"].dataType
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(kind)))


def topic_nodes(topics: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """Topics (id, label, paper_count) with ``papers``: their existing papers (id, title) by title; links are rows (topic_id,
    paper_id)."""
    titled = links.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    held = titled.groupBy(F.col("topic_id").alias("_topic")).agg(F.transform(F.sort_array(F.collect_list(F.struct("title", "paper_id"))), lambda x: F.struct(x["paper_id"].alias("id"), x["title"].alias("title"))).alias("papers"))
    out = topics.join(held, F.col("id") == F.col("_topic"), "left").drop("_topic")
    return out.withColumn("papers", F.coalesce("papers", F.array().cast(held.schema["papers"].dataType)))


def source_prompts(hits: DataFrame) -> DataFrame:
    """Rows (query_id, prompt): a query's sources, numbered in rank order, with title and pages."""
    head = F.format_string("[S%d] %s (p. %d-%d)", F.col("no"), F.col("title"), F.col("page_start"), F.col("page_end"))
    no = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")).cast("int")
    rows = hits.withColumn("no", no).select("query_id", "no", F.concat(head, F.lit("\n"), F.col("text")).alias("t"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "\n\n").alias("prompt"))


def joined_deltas(deltas: DataFrame, key: str = "message_id", order: str = "seq", text: str = "delta") -> DataFrame:
    """Streamed answers put together."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return deltas.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("content"))


def report_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("outcome").agg(F.count("*").alias("n"))


def write_notes(notes: DataFrame, folder: str) -> DataFrame:
    """Writes notes (path, content) below a folder of any file system that Arrow reaches, whole or not at all, and returns
    rows (path, bytes). Lazy: an action on the result writes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, target = fs.FileSystem.from_uri(f"{folder}/{path}")
                system.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content.encode())
                system.move(draft, target)
                sizes.append(len(content.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return notes.select("path", "content").mapInArrow(write, "path string, bytes long")


def watched_notes(spark, folder: str, pattern: str = "*.md") -> DataFrame:
    """A stream of notes (path, content, ts) as they come into a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("ts"))

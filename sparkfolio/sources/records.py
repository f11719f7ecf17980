"""External records: JSON of scholarly search, machine translation and model lists; event streams in text framing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import ascii_lower

RECORD = "paperId string, title string, abstract string, year bigint, venue string, citationCount bigint, authors array<struct<name:string>>, externalIds struct<DOI:string>, openAccessPdf struct<url:string>"
# Parts of names of models that don't write text.
NOT_TEXT = ("embedding", "whisper", "tts", "dall-e", "moderation", "audio", "image", "realtime", "transcribe", "codex")


def search_hits(rows: DataFrame, json_col: str = "json", prefix: str = "semantic-scholar", fallback: str = "Untitled") -> DataFrame:
    """Records as rows; those without an id are dropped, those without a title get a default."""
    r = rows.withColumn("_r", F.from_json(json_col, RECORD))
    return r.where("_r.paperId is not null").select(
        F.concat(F.lit(f"{prefix}:"), "_r.paperId").alias("source_id"),
        F.coalesce(F.nullif(F.trim("_r.title"), F.lit("")), F.lit(fallback)).alias("title"),
        F.coalesce(F.transform("_r.authors", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"),
        F.col("_r.year").alias("year"),
        F.col("_r.venue").alias("venue"),
        F.col("_r.abstract").alias("abstract"),
        F.col("_r.externalIds.DOI").alias("doi"),
        F.col("_r.openAccessPdf.url").alias("pdf_url"),
    )


def open_access(hits: DataFrame) -> DataFrame:
    return hits.where("pdf_url is not null")


def importable(hits: DataFrame) -> DataFrame:
    """Hits whose file may be fetched: over HTTPS only."""
    return hits.where(F.lower("pdf_url").startswith("https://"))


def in_library(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits with the paper that has their DOI, compared in ASCII lower case; of several the smallest id."""
    known = metadata.where("doi is not null").groupBy(ascii_lower(F.col("doi")).alias("_doi")).agg(F.min("paper_id").alias("library_id"))
    return hits.join(known, ascii_lower(F.col("doi")) == F.col("_doi"), "left").drop("_doi")


def overlay(papers: DataFrame, hits: DataFrame, keys: tuple[str, str], columns: list[str]) -> DataFrame:
    """Papers with missing values filled in from the record they came from."""
    h = hits.select(F.col(keys[1]).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = papers.join(h, F.col(keys[0]) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in papers.columns])


def translation_segments(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows (…, segment_no, translated, original): the first list of a translation answer, pair by pair."""
    pairs = F.from_json(F.get_json_object(json_col, "$[0]"), "array<string>")
    seg = rows.select("*", F.posexplode(pairs).alias("segment_no", "_pair"))
    pair = F.from_json("_pair", "array<string>")
    return seg.withColumn("translated", F.try_element_at(pair, F.lit(1))).withColumn("original", F.try_element_at(pair, F.lit(2))).where("translated is not null and original is not null").drop("_pair")


def text_models(ids: DataFrame, id_col: str = "id") -> DataFrame:
    marks = F.lit(False)
    for m in NOT_TEXT:
        marks = marks | F.lower(F.col(id_col)).contains(m)
    return ids.where(~marks).select(id_col).distinct().orderBy(id_col)


def sse_events(chunks: DataFrame, key: str = "stream_id", order: str = "seq", body: str = "chunk") -> DataFrame:
    """Rows (key, event_no, data) of streams given in byte chunks: bytes are joined before they are read as text, so a
    character or a line may be split anywhere; comments, blank lines and the end mark are dropped."""
    parts = F.sort_array(F.collect_list(F.struct(order, F.hex(body).alias("h"))))
    whole = chunks.groupBy(key).agg(F.decode(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")), "UTF-8").alias("text"))
    # A last line without its end is not complete yet.
    lines = F.split("text", "\r?\n")
    data = F.transform(F.filter(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    return whole.select(key, F.posexplode(F.filter(data, lambda d: (d != "") & (d != "[DONE]"))).alias("event_no", "data"))


def fetched(requests: DataFrame, fetch: Callable[[str], str], key: str = "url", out: str = "json") -> DataFrame:
    """Requests with what a caller's function answers; it does its own waiting between attempts (see ``retry_wait``)."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [fetch(u) for u in batch.column(batch.schema.get_field_index(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, out])

    return requests.mapInArrow(run, requests.withColumn(out, F.lit(None).cast("string")).schema)


def retry_wait(status: Column, attempt: Column, retry_after: Column, attempts: int = 3) -> Column:
    """Seconds to wait before the next attempt, or null to give up: for 429 and 5xx only, as told or doubling, 1 to 30."""
    again = ((status == 429) | (status >= 500)) & (attempt < attempts)
    return F.when(again, F.least(F.lit(30), F.greatest(F.lit(1), F.coalesce(retry_after, F.pow(F.lit(2), attempt)))).cast("long"))

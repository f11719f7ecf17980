"""Explicit schemas of the model's tables, as numbered steps that each add or change tables; never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECTS = "array<struct<x:double,y:double,width:double,height:double>>"

#: Step by step: tables that come, or columns that a known table gains.
STEPS: list[dict[str, str]] = [
    {
        "papers": "id string, sha256 string, managed_path string, title string, page_count bigint, import_status string, is_favorite boolean, last_opened_at timestamp, created_at timestamp, updated_at timestamp",
        "paper_metadata": "paper_id string, authors array<string>, year bigint, venue string, doi string, abstract string, source string",
        "groups": "id string, name string, color string, sort_order bigint, created_at timestamp",
        "paper_groups": "paper_id string, group_id string",
        "tags": "id string, normalized_name string, display_name string, source string",
        "paper_tags": "paper_id string, tag_id string",
        "pages": "paper_id string, page_number bigint, width double, height double, rotation bigint, text string",
        "sentences": f"id string, paper_id string, page_number bigint, order_index bigint, text string, rects {RECTS}",
        "highlights": f"id string, paper_id string, page_number bigint, group_key string, color string, selected_text string, rects {RECTS}, note string, created_at timestamp",
        "analyses": "paper_id string, json string, provider string, model string, created_at timestamp",
        "translations": "paper_id string, page_number bigint, target_language string, source_hash string, provider string, model string, prompt_version string, payload string, created_at timestamp",
        "chunks": "id string, paper_id string, section string, page_start bigint, page_end bigint, text string, token_count bigint, content_hash string",
        "relations": "source string, target string, relation_type string, score double, provenance string, created_at timestamp",
        "chat_messages": "id string, session_id string, role string, content string, created_at timestamp",
        "chat_citations": "message_id string, paper_id string, page bigint",
        "jobs": "id string, paper_id string, kind string, status string, priority bigint, attempts bigint, payload string, error_code string, idempotency_key string, not_before timestamp, created_at timestamp, updated_at timestamp",
        "sync_records": "paper_id string, path string, status string, synced_at timestamp",
    },
    {"chunk_vectors": "id string, index_generation bigint, embedding array<float>", "paper_vectors": "id string, index_generation bigint, embedding array<float>"},
    {"sentences": "paragraph_index bigint"},
    {"topics": "id string, label string, n_papers bigint", "paper_topics": "topic_id string, paper_id string", "topic_edges": "a string, b string, kind string, weight double"},
    {"tag_notes": "tag_id string, paper_id string, insight string, evidence_pages array<bigint>, updated_at timestamp"},
    {"papers": "title_source string"},
]


def schema(table: str, version: int | None = None) -> T.StructType:
    """A table's schema after so many steps, all by default."""
    parts = [step[table] for step in STEPS[:version] if table in step]
    if not parts:
        raise KeyError(f"no table {table} at version {len(STEPS) if version is None else version}")
    return T.StructType.fromDDL(", ".join(parts))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's files with its newest schema; columns that older files lack are null."""
    return spark.read.schema(schema(table)).parquet(f"{path}/{table}")


def migrated(df: DataFrame, table: str) -> DataFrame:
    """Rows of any earlier version as the newest: known columns, in order, those that are missing null."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)])

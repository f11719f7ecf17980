"""The driver's tables as the model's: papers, groups, tags, pages, jobs. Each rule also stands as SQL in ``CTE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.documents import page_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STATUSES = ["ready", "failed", "indexing", "copying", "extracting", "waiting_for_ai", "analyzing", "partial"]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.split("text", "\n")[0].alias("title"),
        (F.col("doc_id") * 7919 % 100003).alias("created_at"),
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 104729 % 99991).alias("last_opened_at"),
        (F.col("doc_id") % 7 == 0).alias("is_favorite"),
        status.alias("status"),
        F.when(F.col("doc_id") % 5 == 0, "user").otherwise("file").alias("title_source"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.when(F.col("doc_id") % 10 < 9, 2000 + F.col("doc_id") % 25).cast("long").alias("year"),
        F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string")).alias("doi"),
    )


def paper_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("group_id"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("group_id")).distinct()


def paper_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lang = docs.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("tag"))
    marks = [labels.where(f"{c} = 1").select(F.col("doc_id").alias("paper_id"), F.lit(c).alias("tag")) for c in ("quality", "toxic")]
    return lang.unionByName(marks[0]).unionByName(marks[1]).distinct()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(table(spark, sf_dir, "documents"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: status by order status, priority by order priority, errors and attempts by key."""
    code = F.element_at(F.array(*[F.lit(c) for c in JOB_CODES]), (F.col("o_orderkey") % len(JOB_CODES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 1000).alias("paper_id"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderkey") % 2 == 0, "running").otherwise("waiting_for_key").alias("status"),
        F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 2, 40).otherwise(20).cast("long").alias("priority"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 86400 * 30).alias("not_before"),
        (F.col("o_orderkey") % 5).alias("attempts"),
        F.when(F.col("o_orderstatus") == "O", None).otherwise(code).alias("error_code"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
    )


JOB_CODES = ["ProviderAuth", "Network", "ProviderRateLimit", "Storage", "InvalidPdf", "CredentialStore", "ProviderUnavailable"]

_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
_CODES = "[" + ", ".join(f"'{s}'" for s in JOB_CODES) + "]"

CTE = {
    "papers": f"""papers AS (SELECT doc_id AS id, sha256(text) AS sha256, string_split(text, chr(10))[1] AS title, doc_id * 7919 % 100003 AS created_at,
  CASE WHEN doc_id % 3 > 0 THEN doc_id * 104729 % 99991 END AS last_opened_at, doc_id % 7 = 0 AS is_favorite, {_STATUS}[(doc_id % 8 + 1)::INT] AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'user' ELSE 'file' END AS title_source,
  CASE WHEN doc_id % 10 < 9 THEN 2000 + doc_id % 25 END AS year, '10.1000/' || doc_id AS doi FROM documents)""",
    "paper_groups": "paper_groups AS (SELECT doc_id AS paper_id, source AS group_id FROM documents WHERE doc_id % 11 <> 0)",
    "paper_tags": """paper_tags AS (SELECT doc_id AS paper_id, lang AS tag FROM documents UNION SELECT doc_id, 'quality' FROM labels WHERE quality = 1
  UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)""",
    "pages_": """lines_ AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pages_ AS (SELECT paper_id, ((i - 1) // 40 + 1)::BIGINT AS page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM lines_ GROUP BY ALL)""",
    "vectors": "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)",
    "jobs": f"""jobs AS (SELECT o_orderkey AS id, o_custkey % 1000 AS paper_id,
  CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'waiting_for_key' END AS status,
  CASE WHEN substr(o_orderpriority, 1, 1)::INT <= 2 THEN 40 ELSE 20 END::BIGINT AS priority, epoch(o_orderdate)::BIGINT AS created_at,
  CASE WHEN o_orderkey % 4 = 0 THEN epoch(o_orderdate)::BIGINT + 86400 * 30 END AS not_before, o_orderkey % 5 AS attempts,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {_CODES}[(o_orderkey % {len(JOB_CODES)} + 1)::INT] END AS error_code, epoch(o_orderdate)::BIGINT AS updated_at FROM orders)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"

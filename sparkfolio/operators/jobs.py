"""The durable job queue as tables: claiming, failing, recovering; and the same as a fold over each job's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import backoff_seconds

# Priorities by kind of job, and codes of errors by what is done about them.
PRIORITIES = {"extract": 40, "thumbnail": 40, "embed": 40, "analyze": 40, "relations": 20, "obsidian_sync": 20}
WAIT_CODES = ("ProviderAuth", "ModelUnsupported", "CredentialStore")
RETRY_CODES = ("ProviderRateLimit", "ProviderUnavailable", "Network")
TRANSIENT_CODES = ("CredentialStore", "Network", "Storage", "ProviderUnavailable")
MAX_ATTEMPTS = 3


def claim_next(jobs: DataFrame, now) -> DataFrame:
    """The one job to run next: queued, its gate passed, highest priority, then oldest."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    return ready.orderBy(F.col("priority").desc(), "created_at", "id").limit(1)


def claim_per_queue(jobs: DataFrame, queue: str, now) -> DataFrame:
    """As ``claim_next`` for each queue at once."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    rank = F.row_number().over(Window.partitionBy(queue).orderBy(F.col("priority").desc(), "created_at", "id"))
    return ready.withColumn("_r", rank).where("_r = 1").drop("_r")


def after_failure(jobs: DataFrame, code: str = "error_code", retry_after: str | None = None) -> DataFrame:
    """Running jobs with an error: the status they get, and seconds until they may run again (null: no gate)."""
    wait = F.col(code).isin(*WAIT_CODES)
    again = F.col(code).isin(*RETRY_CODES) & (F.col("attempts") < MAX_ATTEMPTS)
    seconds = backoff_seconds(F.col("attempts"))
    if retry_after:
        seconds = F.coalesce(F.when(F.col(code) == "ProviderRateLimit", F.col(retry_after)), seconds)
    return jobs.withColumn("new_status", F.when(wait, "waiting_for_key").when(again, "queued").otherwise("failed")).withColumn("delay_seconds", F.when(again, seconds).cast("long"))


def recovered(jobs: DataFrame, key_arrived: bool = False) -> DataFrame:
    """The queue after a restart: interrupted jobs run again, transient failures get a fresh chance, and so do those that
    waited for a key once it is there."""
    running, transient = F.col("status") == "running", (F.col("status") == "failed") & F.col("error_code").isin(*TRANSIENT_CODES)
    waiting = (F.col("status") == "waiting_for_key") & F.lit(key_arrived)
    return (
        jobs.withColumn("_again", F.coalesce(running | transient | waiting, F.lit(False)))
        .withColumn("attempts", F.when(transient | waiting, 0).otherwise(F.col("attempts")))
        .withColumn("error_code", F.when(waiting, None).otherwise(F.col("error_code")))
        .withColumn("status", F.when(F.col("_again"), "queued").otherwise(F.col("status")))
        .drop("_again")
    )


def retried(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed and waiting jobs among ``ids`` are queued anew; others are as they were."""
    marked = jobs.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("status").isin("failed", "waiting_for_key")
    return marked.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts"))).withColumn("error_code", F.when(hit, None).otherwise(F.col("error_code"))).withColumn("status", F.when(hit, "queued").otherwise(F.col("status"))).drop("_id")


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Queued and waiting jobs among ``ids`` are cancelled."""
    marked = jobs.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("status").isin("queued", "waiting_for_key")
    return marked.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_id")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted jobs (paper_id, kind, version) whose idempotency key is new, each once, with their priority."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITIES.items() for x in p]), F.col("kind")), F.lit(20))
    keyed = wanted.withColumn("idempotency_key", F.concat_ws(":", F.col("paper_id").cast("string"), "kind", "version")).dropDuplicates(["idempotency_key"])
    return keyed.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").select("idempotency_key", "paper_id", "kind", priority.cast("long").alias("priority"), F.lit("queued").alias("status"))


def blocked(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    titles = papers.select(F.col("id").alias("_paper"), "title")
    return jobs.where(F.col("status").isin("failed", "waiting_for_key")).join(titles, F.col("paper_id") == F.col("_paper"), "left").drop("_paper").orderBy(F.col("updated_at").desc(), "id")


def pending_count(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running")).agg(F.count("*").alias("pending"))


def next_kinds(done: DataFrame, analysed: DataFrame) -> DataFrame:
    """Jobs that a finished one (paper_id, kind) calls for: extraction is followed by embedding, and by analysis where there is
    none yet; embedding and analysis by relations."""
    kinds = F.when(F.col("kind") == "extract", F.array(F.lit("embed"), F.lit("analyze"))).when(F.col("kind").isin("embed", "analyze"), F.array(F.lit("relations"))).otherwise(F.array().cast("array<string>"))
    called = done.select("paper_id", F.explode(kinds).alias("kind")).distinct()
    known = analysed.select("paper_id", F.lit("analyze").alias("kind"))
    return called.join(known, ["paper_id", "kind"], "left_anti")


def ready_after_embedding(papers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Indexing papers become ready unless an analysis is queued or running."""
    busy = jobs.where("kind = 'analyze' and status in ('queued', 'running')").select(F.col("paper_id").alias("_paper")).distinct()
    marked = papers.join(busy, F.col("id") == F.col("_paper"), "left")
    return marked.withColumn("status", F.when((F.col("status") == "indexing") & F.col("_paper").isNull(), "ready").otherwise(F.col("status"))).drop("_paper")


def final_states(events: DataFrame) -> DataFrame:
    """Rows (job_id, status, attempts): the state machine run over each job's events (job_id, seq, event, error_code).

    A fold in Spark's own aggregate over a job's ordered events: few per job.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "event", "error_code")))
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempts"))

    def step(s, e):
        status, attempts, event = s["status"], s["attempts"], e["event"]
        failed = F.when(e["error_code"].isin(*WAIT_CODES), "waiting_for_key").when(e["error_code"].isin(*RETRY_CODES) & (attempts < MAX_ATTEMPTS), "queued").otherwise("failed")
        new = (
            F.when((event == "claim") & (status == "queued"), "running")
            .when((event == "complete") & (status == "running"), "completed")
            .when((event == "fail") & (status == "running"), failed)
            .when((event == "retry") & status.isin("failed", "waiting_for_key"), "queued")
            .when((event == "cancel") & status.isin("queued", "waiting_for_key"), "cancelled")
            .when((event == "recover") & (status == "running"), "queued")
            .otherwise(status)
        )
        count = F.when((event == "claim") & (status == "queued"), attempts + 1).when((event == "retry") & status.isin("failed", "waiting_for_key"), F.lit(0).cast("long")).otherwise(attempts)
        return F.struct(new.alias("status"), count.alias("attempts"))

    return events.groupBy("job_id").agg(F.aggregate(ordered, start, step).alias("s")).select("job_id", "s.status", "s.attempts")

"""Page translation: source text with offsets, segments mapped back to sentences, and the cache of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_source(sentences: DataFrame, partition: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Rows (page, source) of joined sentences, a space within a paragraph and a line end between two; and the sentences
    (page, order_index, paragraph_index, id, text) with their ranges."""
    w = Window.partitionBy(partition).orderBy("order_index")
    lead = F.when(F.row_number().over(w) == 1, "").when(F.lag("paragraph_index").over(w) == F.col("paragraph_index"), " ").otherwise("\n")
    s = sentences.withColumn("lead", lead)
    end = F.sum(F.length("lead") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = s.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("text"))
    parts = F.sort_array(F.collect_list(F.struct("order_index", F.concat("lead", "text").alias("t"))))
    return s.groupBy(partition).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("source")), ranges


#: Characters of a bin; a range stands in each bin that it touches.
BIN = 1024


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(start), F.col(end) - 1) / BIN))))


def map_segments(ranges: DataFrame, segments: DataFrame, partition: str = "page_id") -> DataFrame:
    """Rows (page, segment_no, text, sentence_ids, paragraph_index): each translated segment (page, segment_no, original,
    translated) with the sentences its original overlaps, or else the nearest before it. Blank segments are dropped.

    Ranges are cut into bins of a page, and meet where they share one, in the first that they share; the sentence before a
    segment comes from one pass over both in order.  A page of many sentences takes time in proportion to them.
    """
    before = Window.partitionBy(partition).orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("s_start", F.coalesce(F.sum(F.length("original")).over(before), F.lit(0))).withColumn("s_end", F.col("s_start") + F.length("original"))
    s = s.withColumn("text", F.trim("translated")).where("text <> ''").select(partition, "segment_no", "text", "s_start", "s_end")
    r = ranges.select(F.col(partition).alias("_p"), F.struct("start", "order_index", "id", "paragraph_index").alias("r"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    over = (F.col("r_start") < F.col("s_end")) & (F.col("r_end") > F.col("s_start"))
    first_shared = F.floor(F.greatest("s_start", "r_start") / BIN) == F.col("bin")
    pairs = _binned(s, "s_start", "s_end").join(_binned(r, "r_start", "r_end").withColumnRenamed("bin", "_bin"), (F.col(partition) == F.col("_p")) & (F.col("bin") == F.col("_bin")) & over & first_shared)
    hits = pairs.groupBy(F.col(partition).alias("_p"), F.col("segment_no").alias("_s")).agg(F.sort_array(F.collect_list("r")).alias("hit"))
    # Sentences before segments that start at the same place, then the last sentence so far.
    marks = r.select(F.col("_p").alias(partition), F.col("r_start").alias("at"), F.lit(0).alias("is_segment"), F.lit(None).cast(s.schema["segment_no"].dataType).alias("segment_no"), "r")
    asked = s.select(partition, F.col("s_start").alias("at"), F.lit(1).alias("is_segment"), "segment_no", F.lit(None).cast(r.schema["r"].dataType).alias("r"))
    so_far = Window.partitionBy(partition).orderBy("at", "is_segment", F.col("r.order_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.unionByName(asked).withColumn("last", F.last("r", True).over(so_far)).where("is_segment = 1").select(F.col(partition).alias("_q"), F.col("segment_no").alias("_t"), "last")
    met = s.join(hits, (F.col(partition) == F.col("_p")) & (F.col("segment_no") == F.col("_s")), "left").join(last, (F.col(partition) == F.col("_q")) & (F.col("segment_no") == F.col("_t")), "left")
    none = F.array().cast(hits.schema["hit"].dataType)
    out = met.withColumn("chosen", F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.col("last").isNotNull(), F.array("last")).otherwise(none))
    return out.select(partition, "segment_no", "text", F.transform("chosen", lambda x: x["id"]).alias("sentence_ids"), F.coalesce(F.try_element_at("chosen", F.lit(1))["paragraph_index"], F.lit(0)).alias("paragraph_index"))


def incomplete(sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """Sentences that an answer lacks or leaves blank; a translation is complete where there are none."""
    return sentences.join(answers.where(F.trim("text") != "").select("id"), "id", "left_anti")


CACHE_KEY = ["paper_id", "page_number", "target_language", "source_hash", "provider", "model", "prompt_version"]


def cached(requests: DataFrame, cache: DataFrame, sentences: DataFrame) -> DataFrame:
    """Requests (the cache key's columns) with the latest entry's ``sentence_ids`` and ``payload``; an entry that names
    sentences of which none is live any more is a miss."""
    rank = F.row_number().over(Window.partitionBy(*CACHE_KEY).orderBy(F.col("created_at").desc(), "payload"))
    latest = cache.withColumn("_r", rank).where("_r = 1").drop("_r")
    live = sentences.groupBy("paper_id", "page_number").agg(F.collect_set("id").alias("_live"))
    found = requests.join(latest, CACHE_KEY).join(live, ["paper_id", "page_number"], "left")
    ok = (F.size("sentence_ids") == 0) | F.coalesce(F.arrays_overlap("sentence_ids", "_live"), F.lit(False))
    return found.where(ok).drop("_live")


def cache_identity(settings: DataFrame, free: tuple[str, str] = ("google", "gtx")) -> DataFrame:
    """Settings (engine, provider, model) with the provider and model that name a cached result; null if none is set up."""
    llm = F.col("engine") == "llm"
    ready = F.col("provider").isNotNull() & F.col("model").isNotNull()
    return settings.withColumn("cache_provider", F.when(llm, F.when(ready, F.col("provider"))).otherwise(free[0])).withColumn("cache_model", F.when(llm, F.when(ready, F.col("model"))).otherwise(free[1]))

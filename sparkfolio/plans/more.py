"""Registered queries of the smaller joins, projections and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import text as X
from sparkfolio.operators import layout, library, lookups, translation
from sparkfolio.plans import model as M
from sparkfolio.plans.model import with_
from sparkfolio.plans.registry import _FILES, _REL, _files, _relations, query
from sparkfolio.sources import importing, records


@query(
    with_("papers")
    + ", "
    + _REL
    + """, s AS (SELECT r.source, p.title, CASE WHEN relation_type = 'manual' THEN 1.0 END AS score FROM rel r JOIN papers p ON p.id = r.target)
SELECT source, sha256(string_agg(title, chr(10) ORDER BY score DESC NULLS LAST, title)) AS titles FROM s GROUP BY 1"""
)
def related_titles(spark, sf):
    out = lookups.related_titles(_relations(spark, sf), M.papers(spark, sf))
    return out.select("source", X.text_hash(F.array_join("titles", "\n")).alias("titles"))


@query("WITH " + _REL + ", new AS (SELECT doc_id AS source, doc_id % 50 AS target FROM documents WHERE doc_id % 4 = 0 AND doc_id <> doc_id % 50)\nSELECT source, target, relation_type FROM rel WHERE NOT (relation_type = 'manual' AND (source, target) IN (SELECT (source, target) FROM new)) UNION ALL SELECT source, target, 'manual' FROM new")
def manual_relations(spark, sf):
    new = M.papers(spark, sf).where("id % 4 = 0").select(F.col("id").alias("source"), (F.col("id") % 50).alias("target"))
    return lookups.add_manual(_relations(spark, sf), new).select("source", "target", "relation_type")


@query(
    """WITH e AS (SELECT user_id AS tag_id, event_id % 100 AS paper_id, max(event_id) AS insight, max(event_id) AS updated_at FROM events GROUP BY ALL),
t AS (SELECT DISTINCT user_id AS tag_id, upper(event_type) AS label FROM events)
SELECT label, e.paper_id, insight, row_number() OVER (PARTITION BY label ORDER BY updated_at DESC, e.tag_id, e.paper_id) AS place FROM e JOIN (SELECT tag_id, lower(label) AS label FROM t) USING (tag_id) JOIN documents d ON d.doc_id = e.paper_id"""
)
def tag_note_lookup(spark, sf):
    e = M.table(spark, sf, "events")
    entries = e.groupBy(F.col("user_id").alias("tag_id"), (F.col("event_id") % 100).alias("paper_id")).agg(F.max("event_id").alias("insight"), F.max("event_id").alias("updated_at"))
    tags = e.select(F.col("user_id").alias("tag_id"), F.upper("event_type").alias("label")).distinct()
    return lookups.tag_notes(entries, tags, M.papers(spark, sf), e.select(F.col("event_type").alias("label")).distinct()).select("label", "paper_id", "insight", F.col("place").cast("long").alias("place"))


@query(
    """WITH h AS (SELECT doc_id // 10 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS no, string_split(text, chr(10))[1] AS title, text FROM documents)
SELECT query_id, sha256(string_agg('[S' || no || '] ' || title || ' (p. 1-2)' || chr(10) || text, chr(10) || chr(10) ORDER BY no)) AS prompt FROM h GROUP BY 1"""
)
def source_prompts(spark, sf):
    h = M.table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("query_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), F.split("text", "\n")[0].alias("title"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), "text")
    return lookups.source_prompts(h).select("query_id", X.text_hash(F.col("prompt")).alias("prompt"))


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM conversations GROUP BY 1")
def chat_deltas(spark, sf):
    out = lookups.joined_deltas(M.table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", X.text_hash(F.col("content")).alias("content"))


@query(
    """WITH h AS (SELECT doc_id // 7 AS paper_id, doc_id AS id, trim(string_split(text, chr(10))[-1], ' ') AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS no FROM h WHERE strlen(t) > 2) SELECT paper_id, string_agg(no || '. ' || t, chr(10) ORDER BY no) AS source FROM k GROUP BY 1"""
)
def highlight_summary(spark, sf):
    h = M.table(spark, sf, "documents").select(F.expr("doc_id div 7").alias("paper_id"), F.col("doc_id").alias("id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("created_at"), F.element_at(F.split("text", "\n"), -1).alias("selected_text"))
    return library.numbered_highlights(h)


@query("WITH " + _FILES + " SELECT CASE WHEN reason IS NULL THEN 'usable' ELSE reason END AS outcome, count(*) AS n FROM r GROUP BY 1")
def import_report(spark, sf):
    f = _files(spark, sf)
    return lookups.report_counts(f.select(F.coalesce(importing.rejection(F.col("content")), F.lit("usable")).alias("outcome")))


_ITEMS = "items AS (SELECT l_orderkey AS paper_id, l_linenumber AS item_no, (l_partkey % 100) / 100.0::DOUBLE AS y, (l_suppkey % 30 + 1) / 1000.0::DOUBLE AS height FROM lineitem)"


def _items(spark, sf):
    return M.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("item_no"), F.lit("t").alias("text"),
        ((F.col("l_partkey") % 100) / F.lit(100.0)).alias("y"), ((F.col("l_suppkey") % 30 + 1) / F.lit(1000.0)).alias("height"), ((F.col("l_partkey") % 97) / F.lit(100.0)).alias("x"),
    )


@query("WITH " + _ITEMS + ", m AS (SELECT paper_id, list_sort(list(height))[len(list(height)) // 2 + 1] AS m FROM items GROUP BY 1)\nSELECT paper_id, y, height, y >= 0.88 AND height < m * 0.85 AS is_footnote FROM items JOIN m USING (paper_id)")
def footnote_band(spark, sf):
    return layout.footnotes(_items(spark, sf)).select("paper_id", "y", "height", "is_footnote")


@query(
    """WITH items AS (SELECT l_suppkey AS paper_id, (CASE WHEN l_partkey % 97 BETWEEN 40 AND 49 THEN 50 ELSE l_partkey % 97 END) / 100.0::DOUBLE AS x FROM lineitem), n AS (SELECT paper_id, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 12),
g AS (SELECT unnest(range(42, 63)) / 100.0::DOUBLE AS gutter),
s AS (SELECT paper_id, gutter, sum((x >= gutter - 0.045 AND x < gutter - 0.005)::INT) AS band, sum((x < gutter)::INT) AS l FROM items, g GROUP BY ALL),
b AS (SELECT paper_id, n, arg_min(gutter, (band, gutter)) AS gutter, min(band) AS band FROM s JOIN n USING (paper_id) WHERE l >= n * 0.25 AND n - l >= n * 0.25 GROUP BY ALL)
SELECT paper_id, gutter FROM b WHERE band < n * 0.03"""
)
def column_gutters(spark, sf):
    items = M.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("paper_id"), F.lit(1).alias("page_number"), F.lit("t").alias("text"), F.expr("(case when l_partkey % 97 between 40 and 49 then 50 else l_partkey % 97 end) / 100.0D").alias("x"))
    return layout.column_gutters(items).select("paper_id", "gutter")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'google' WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS p FROM documents")
def cache_identity(spark, sf):
    s = M.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "free").otherwise("llm").alias("engine"), F.col("source").alias("provider"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("model"))
    return translation.cache_identity(s).select("doc_id", F.col("cache_provider").alias("p"))


@query(
    """WITH c AS (SELECT doc_id // 4 AS k, doc_id, doc_id % 5 AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, lpad(doc_id::VARCHAR, 9, '0')) AS rn FROM c)
SELECT k AS paper_id, lpad(doc_id::VARCHAR, 9, '0') AS payload FROM r WHERE rn = 1 AND (doc_id % 3 = 0 OR doc_id % 3 = 1)"""
)
def translation_cache(spark, sf):
    d = M.table(spark, sf, "documents")
    key = [F.expr("doc_id div 4").alias("paper_id"), F.lit(1).alias("page_number"), *[F.lit("x").alias(c) for c in translation.CACHE_KEY[2:]]]
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("live"), F.lit("gone"))).otherwise(F.array(F.lit("gone")))
    cache = d.select(*key, (F.col("doc_id") % 5).alias("created_at"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("payload"), ids.alias("sentence_ids"))
    sentences = d.select(F.expr("doc_id div 4").alias("paper_id"), F.lit(1).alias("page_number"), F.lit("live").alias("id"))
    return translation.cached(d.select(*key).distinct(), cache, sentences).select("paper_id", "payload")


@query("SELECT doc_id, 'D' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS library_id FROM documents")
def library_by_doi(spark, sf):
    d = M.table(spark, sf, "documents")
    hits = d.select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doi"))
    known = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doi"))
    return records.in_library(hits, known)

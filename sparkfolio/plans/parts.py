"""Registered queries of page geometry, small joins, guarded job changes, topics and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as X
from sparkfolio.operators import analysis, blocks, graphs, layout, library, lookups, notes, search, translation, upserts
from sparkfolio.operators import jobs as queue
from sparkfolio.plans import model as M
from sparkfolio.plans.model import with_
from sparkfolio.plans.registry import query, with_long
from sparkfolio.sources import importing, records

# -- rectangles: each line of an order is one, in fractions that fall inside and outside the page -----------------------

_RECTS = """r AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 13 - 1) / 10.0::DOUBLE AS x, (l_suppkey % 12 - 1) / 10.0::DOUBLE AS y, (l_partkey % 7) / 10.0::DOUBLE AS w, (l_suppkey % 5) / 10.0::DOUBLE AS h FROM lineitem),
c AS (SELECT *, least(greatest(x, 0.0), 1.0) AS cx, least(greatest(y, 0.0), 1.0) AS cy FROM r),
d AS (SELECT *, greatest(0.0, least(w, 1.0 - cx)) AS cw, greatest(0.0, least(h, 1.0 - cy)) AS ch FROM c)"""


def _rect_rows(spark, sf):
    part = lambda e: F.expr(e)
    return M.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.struct(part("(l_partkey % 13 - 1) / 10.0D").alias("x"), part("(l_suppkey % 12 - 1) / 10.0D").alias("y"), part("(l_partkey % 7) / 10.0D").alias("width"), part("(l_suppkey % 5) / 10.0D").alias("height")).alias("r"),
    )


@query("WITH " + _RECTS + " SELECT k, n, x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND h > 0 AND x + w <= 1.0001 AND y + h <= 1.0001 AS valid FROM r")
def rect_valid(spark, sf):
    return _rect_rows(spark, sf).select("k", "n", X.rect_valid(F.col("r")).alias("valid"))


@query("WITH " + _RECTS + " SELECT k, n, round(cx, 6) AS x, round(cy, 6) AS y, round(cw, 6) AS width, round(ch, 6) AS height FROM d")
def rect_clamped(spark, sf):
    out = _rect_rows(spark, sf).select("k", "n", X.rect_clamp(F.col("r")).alias("r"))
    return out.select("k", "n", *[F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query("WITH " + _RECTS + " SELECT k, count(*) AS n_rects FROM d WHERE cw > 0 AND ch > 0 AND cx + cw <= 1.0001 AND cy + ch <= 1.0001 GROUP BY k")
def usable_sentences(spark, sf):
    sentences = _rect_rows(spark, sf).groupBy("k").agg(F.collect_list("r").alias("rects"))
    return importing.usable_sentences(sentences).select("k", F.size("rects").cast("long").alias("n_rects"))


_LEVELS = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 50) / 60.0::DOUBLE AS x, (l_suppkey % 5) / 6.0::DOUBLE AS y, 0.05::DOUBLE AS w, 0.02::DOUBLE AS h FROM lineitem)"


def _level_rows(spark, sf):
    return M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.expr("(l_partkey % 50) / 60.0D").alias("x"), F.expr("(l_suppkey % 5) / 6.0D").alias("y"), F.lit(0.05).alias("width"), F.lit(0.02).alias("height"))


@query("WITH " + _LEVELS + " SELECT k, round(y, 6) AS y, round(min(x), 6) AS x, round(max(x + w) - min(x), 6) AS width FROM b GROUP BY k, y")
def merged_rects(spark, sf):
    rects = _level_rows(spark, sf).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.struct("x", "y", "width", "height").alias("r")))), lambda z: z["r"]).alias("rects"))
    out = layout.with_merged_rects(rects).select("k", F.explode("merged").alias("m"))
    return out.select("k", F.round("m.y", 6).alias("y"), F.round("m.x", 6).alias("x"), F.round("m.width", 6).alias("width"))


_CUT = """p AS (SELECT *, 0.4 - 0.005 AS lo, 0.4 + 0.1 + 0.005 AS hi, x + w AS e, 1 / 6.0::DOUBLE AS cy FROM b),
q AS (SELECT *, least(y + h, cy + 0.02) - greatest(y, cy) > 0.02 * 0.4 AS same, least(greatest(lo, x), e) AS le, greatest(least(hi, e), x) AS rs FROM p)"""


@query(
    "WITH "
    + _LEVELS
    + ", "
    + _CUT
    + """ SELECT k, n, 0 AS part, round(x, 6) AS x, round(w, 6) AS width FROM q WHERE NOT same OR hi <= x OR lo >= e
UNION ALL SELECT k, n, 1, round(x, 6), round(le - x, 6) FROM q WHERE same AND hi > x AND lo < e AND le - x > 0.004 UNION ALL SELECT k, n, 2, round(rs, 6), round(e - rs, 6) FROM q WHERE same AND hi > x AND lo < e AND e - rs > 0.004"""
)
def word_subtracted(spark, sf):
    """A word's rectangle cut out of each line's; part tells what is left: all of it, what lies left of the word, or right."""
    word = F.struct(F.lit(0.4).alias("x"), F.lit(1 / 6.0).alias("y"), F.lit(0.1).alias("width"), F.lit(0.02).alias("height"))
    rows = _level_rows(spark, sf).withColumn("r", F.struct("x", "y", "width", "height"))
    out = rows.select("k", "n", "x", "width", F.explode(layout.subtract_rect(F.array("r"), word)).alias("m"))
    part = F.when((F.col("m.x") == F.col("x")) & (F.col("m.width") == F.col("width")), 0).when(F.col("m.x") == F.col("x"), 1).otherwise(2)
    return out.select("k", "n", part.alias("part"), F.round("m.x", 6).alias("x"), F.round("m.width", 6).alias("width"))


@query(
    "WITH "
    + _LEVELS
    + ", "
    + _CUT
    + """, s AS (SELECT k, n, 0 AS part, CASE WHEN same THEN le - x ELSE w END AS w FROM q WHERE (same AND le - x > 0.004) OR (NOT same AND y + h <= cy + 0.01)
  UNION ALL SELECT k, n, 1, CASE WHEN same THEN e - rs ELSE w END FROM q WHERE (same AND e - rs > 0.004) OR (NOT same AND NOT y + h <= cy + 0.01)),
g AS (SELECT k, part, round(sum(w), 6) AS width, count(*) AS n_rects FROM s GROUP BY ALL)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY part) - 1 AS part, width, n_rects FROM g"""
)
def highlight_split(spark, sf):
    """Highlights of which a word is deleted: what lies before and after it becomes a highlight each."""
    word = F.struct(F.lit(0.4).alias("x"), F.lit(1 / 6.0).alias("y"), F.lit(0.1).alias("width"), F.lit(0.02).alias("height"))
    h = _level_rows(spark, sf).groupBy(F.col("k").alias("id")).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("rects"))
    out = lookups.without_word(h, word)
    return out.select(F.col("id").alias("k"), F.col("part").cast("long").alias("part"), F.round(F.aggregate("rects", F.lit(0.0), lambda s, r: s + r["width"]), 6).alias("width"), F.size("rects").cast("long").alias("n_rects"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(l_partkey % 600 / 600.0, 6) AS x, round(1 - (l_suppkey % 780 + 10.0) / 800, 6) AS y, round(l_quantity / 600, 6) AS width, round(10 / 800.0, 6) AS height FROM lineitem")
def glyph_rects(spark, sf):
    m = F.array(F.lit(10.0), F.lit(0.0), F.lit(6.0), F.lit(8.0), F.expr("double(l_partkey % 600)"), F.expr("double(l_suppkey % 780)"))
    r = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), layout.glyph_rect(m, F.col("l_quantity"), F.lit(600.0), F.lit(800.0)).alias("r"))
    return r.select("k", "n", *[F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    "WITH "
    + _LEVELS
    + """, hit AS (SELECT k, greatest(x, 0.1) AS a, least(x + w, 0.7) AS e FROM b WHERE y = 1 / 6.0::DOUBLE AND x < 0.7 AND x + w > 0.1),
o AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
g AS (SELECT *, sum(CASE WHEN a - reach > 0.014 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT k, island::BIGINT AS island, round(min(a), 6) AS x, round(max(e) - min(a), 6) AS width FROM g GROUP BY k, island"""
)
def clipped_to_glyphs(spark, sf):
    glyphs = _level_rows(spark, sf).select(F.col("k").alias("paper_id"), F.lit(1).alias("page_number"), "x", "y", "width", "height")
    rects = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id")).distinct().select("paper_id", F.lit(1).alias("page_number"), F.lit(0).alias("rect_no"), F.lit(0.1).alias("x"), F.lit(1 / 6.0).alias("y"), F.lit(0.6).alias("width"), F.lit(0.02).alias("height"))
    return layout.clip_to_glyphs(rects, glyphs).select(F.col("paper_id").alias("k"), "island", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"))


@query(
    """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, 'ab cde f' AS t, l_linenumber / 10.0::DOUBLE AS y, l_partkey % 90 AS px FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1), c AS (SELECT *, floor((0.1 + px / 200.0 - 0.1) / 0.05)::INT AS pos FROM i WHERE px / 200.0 <= 0.4),
w AS (SELECT *, CASE WHEN pos IN (0, 1) THEN 'ab' WHEN pos IN (3, 4, 5) THEN 'cde' WHEN pos >= 7 THEN 'f' END AS word FROM c)
SELECT k * 10 + n AS point_id, word AS text FROM w WHERE word IS NOT NULL"""
)
def word_under_point(spark, sf):
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey"))
    rows = M.table(spark, sf, "lineitem").withColumn("_r", first).where("_r = 1")
    rows = rows.select(F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("item_no"), F.expr("l_linenumber / 10.0D").alias("y"), F.expr("0.1D + (l_partkey % 90) / 200.0D").alias("px"))
    items = rows.select("paper_id", "page_number", "item_no", F.lit("ab cde f").alias("text"), F.lit(0.1).alias("x"), "y", F.lit(0.4).alias("width"), F.lit(0.05).alias("height"))
    points = rows.select("paper_id", "page_number", (F.col("paper_id") * 10 + F.col("item_no")).alias("point_id"), "px", (F.col("y") + 0.02).alias("py"))
    return layout.word_at(items, points).select("point_id", "text")


# -- pages: a document's lines as glyph runs ------------------------------------------------------------------------------

_RUNS = """lines_ AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
kept AS (SELECT doc_id, i, line, string_split(trim(line), ' ') AS words FROM lines_ WHERE trim(line) <> '')"""


def _runs(spark, sf):
    """Two glyph runs per line: its first word, and the rest after a space, a little lower; a page is one column of lines."""
    lines = M.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''").withColumn("line", F.trim("line"))
    first, rest = F.regexp_extract("line", "^([^ ]*)", 1), F.regexp_extract("line", "^[^ ]*( .*)$", 1)
    parts = F.posexplode(F.filter(F.array(first, rest), lambda t: t != "")).alias("at", "text")
    rows = lines.select("paper_id", "i", parts)
    return rows.select(
        "paper_id", F.lit(1).alias("page_number"), (F.col("i") * 2 + F.col("at")).alias("item_no"), "text", (F.lit(0.1) + F.col("at") * 0.1).alias("x"), F.lit(0.3).alias("y"), F.when(F.col("at") == 0, 0.1).otherwise(0.7).alias("width"),
        F.lit(0.01).alias("height"), (F.col("i") * 20.0 + F.col("at") * 2).alias("baseline"), F.lit(10.0).alias("height_pt"), (F.col("at") * 50.0).alias("left_pt"),
    )


@query("WITH " + _RUNS + " SELECT doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no, sha256(trim(line)) AS text FROM kept")
def page_lines(spark, sf):
    return layout.page_lines(_runs(spark, sf)).select("paper_id", "line_no", X.text_hash(F.col("text")).alias("text"))


@query("WITH " + _RUNS + " SELECT doc_id AS paper_id, count(*) AS n_items, 0::BIGINT AS n_right FROM (SELECT doc_id, unnest(CASE WHEN contains(trim(line), ' ') THEN [1, 2] ELSE [1] END) FROM kept) GROUP BY 1")
def reading_columns(spark, sf):
    out = layout.reading_columns(_runs(spark, sf))
    return out.groupBy("paper_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("column") == 1).alias("n_right"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 12.0 + l_partkey % 9 AS base, (l_suppkey % 10) / 10.0 AS r, CASE WHEN l_quantity > 25 THEN 'Ends here.' ELSE 'goes on' END AS t FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
e AS (SELECT *, lead(base) OVER (PARTITION BY k ORDER BY n) - base > 10 * 1.6 OR (r < max(r) OVER (PARTITION BY k) - 0.12 AND t = 'Ends here.') AS ends FROM l)
SELECT k AS paper_id, n AS line_no, coalesce(sum(coalesce(ends, FALSE)::INT) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph FROM e"""
)
def paragraph_breaks(spark, sf):
    # Of rows that tie, the first of the file, so that the dealing of rows to tasks doesn't decide.
    items = M.table(spark, sf, "lineitem").withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "_file", "_at"))
    rows = items.withColumn("_r", first).where("_r = 1")
    lines = rows.select(F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_number"), F.lit(0).alias("column"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_quantity") > 25, "Ends here.").otherwise("goes on").alias("text"),
        F.expr("l_linenumber * 12.0D + l_partkey % 9").alias("baseline"), F.expr("(l_suppkey % 10) / 10.0D").alias("right"), F.lit(10.0).alias("height_pt"))
    return layout.paragraphs(lines).select("paper_id", "line_no", "paragraph")


@query(
    "WITH " + _RUNS + """, t AS (SELECT doc_id, i, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM kept)
SELECT doc_id AS paper_id, line AS title FROM t WHERE n = 1 AND length(line) >= 4 AND regexp_matches(line, '[a-zA-Z\\x{00C0}-\\x{024F}]') AND (SELECT count(*) FROM kept k WHERE k.doc_id = t.doc_id) >= 4"""
)
def layout_titles(spark, sf):
    """The first line set large over pages of four lines and more."""
    runs = _runs(spark, sf)
    first = runs.groupBy("paper_id").agg(F.min("item_no").alias("_first"), F.count_distinct(F.floor(F.col("item_no") / 2)).alias("_lines"))
    items = runs.join(first, "paper_id").where("_lines >= 4").withColumn("height", F.when(F.floor(F.col("item_no") / 2) == F.floor(F.col("_first") / 2), 0.02).otherwise(F.col("height"))).drop("_first", "_lines")
    return layout.layout_titles(items)


@query(
    """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)
SELECT k AS paper_id, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS order_index, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS paragraph_index, 'Sentence ' || p || ' goes over two lines.' AS text, 2::BIGINT AS n_rects FROM d"""
)
def pages_extracted(spark, sf):
    """Sentences of two lines each, the first parted by a hyphen, with a wide gap below: a paragraph, a sentence, two bars."""
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey"))
    rows = M.table(spark, sf, "lineitem").withColumn("_r", first).where("_r = 1")
    parts = F.array(F.concat(F.lit("Sentence "), F.col("l_partkey"), F.lit(" go-")), F.lit("es over two lines."))
    items = rows.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("n"), F.posexplode(parts).alias("at", "text"))
    items = items.select("paper_id", F.lit(1).alias("page_number"), (F.col("n") * 2 + F.col("at")).alias("item_no"), "text", F.lit(0.1).alias("x"), (F.col("n") * 0.08 + F.col("at") * 0.02).alias("y"), F.lit(0.8).alias("width"), F.lit(0.01).alias("height"),
        (F.col("n") * 60.0 + F.col("at") * 12).alias("baseline"), F.lit(10.0).alias("height_pt"), F.lit(10.0).alias("left_pt"))
    return layout.extracted(items).select("paper_id", "order_index", "paragraph_index", "text", F.size("rects").cast("long").alias("n_rects"))


# -- small joins and lookups ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark, sf):
    orders = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return lookups.by_key(orders, id=orders.agg(F.min("id")).first()[0])


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id = 7) SELECT i AS order_index, text FROM l WHERE (i - 1) // 40 = 0")
def sentences_of_page(spark, sf):
    lines = M.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    s = lines.select("paper_id", F.expr("int(i div 40 + 1)").alias("page_number"), (F.col("i") + 1).cast("long").alias("order_index"), "text")
    return lookups.page_sentences(s, 7, 1).select("order_index", "text")


@query("SELECT l_orderkey AS id, l_linenumber AS n, coalesce([ 'yellow', 'green', 'blue', 'pink', 'orange', 'purple', NULL ][l_partkey %% 7 + 1] NOT IN (%s), TRUE) AS rejected FROM lineitem" % ", ".join(f"'{c}'" for c in library.COLORS))
def colors_checked(spark, sf):
    color = F.try_element_at(F.array(*[F.lit(c) for c in ("yellow", "green", "blue", "pink", "orange", "purple", None)]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return lookups.checked_colors(M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), color.alias("color"))).select("id", "n", "rejected")


@query("SELECT doc_id AS source_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0")
def open_access_https(spark, sf):
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.when(F.col("doc_id") % 4 == 0, "HTTPS://x/").otherwise("http://x/"), F.col("doc_id").cast("string")))
    hits = M.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 != 0, url).alias("pdf_url"))
    return records.importable(records.open_access(hits)).select("source_id")


@query("SELECT doc_id, doc_id % 3 = 0 AS ok FROM documents")
def source_ids_guarded(spark, sf):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("semantic-scholar:a"), F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("semantic-scholar:../"), F.col("doc_id"))).otherwise(F.concat(F.lit("other:"), F.col("doc_id")))
    return M.table(spark, sf, "documents").select("doc_id", X.source_id_ok(own, "semantic-scholar").alias("ok"))


@query(with_("papers") + "SELECT o_orderkey AS paper_id, p.title AS paper_title, o_orderstatus AS status FROM orders JOIN papers p ON p.id = o_orderkey")
def sync_records(spark, sf):
    r = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_comment" if "o_comment" in M.table(spark, sf, "orders").columns else "o_orderpriority").alias("vault_path"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return lookups.sync_list(r, M.papers(spark, sf)).select("paper_id", "paper_title", "status")


@query(
    """WITH m AS (SELECT conv_id * 1000 + turn AS message_id, role FROM conversations), c AS (SELECT m.message_id, g AS place, (m.message_id * 7 + g * 13) % 5000 AS paper_id FROM m, (SELECT unnest([1, 2, 3]) AS g))
SELECT message_id, role, coalesce((SELECT string_agg(c.place || ':' || c.paper_id, ',' ORDER BY c.place) FROM c WHERE c.message_id = m.message_id AND c.paper_id IN (SELECT doc_id FROM documents)), '') AS cited FROM m"""
)
def messages_with_citations(spark, sf):
    m = M.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role")
    c = m.select("message_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("place"))
    c = c.select("message_id", "place", F.col("place").cast("string").alias("chunk_id"), ((F.col("message_id") * 7 + F.col("place") * 13) % 5000).alias("paper_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))
    out = lookups.with_citations(m, c, M.papers(spark, sf))
    return out.select("message_id", "role", F.array_join(F.transform("citations", lambda x: F.concat(x["chunk_id"], F.lit(":"), x["paper_id"].cast("string"))), ",").alias("cited"))


@query(with_("papers") + "SELECT s_suppkey AS id, count(p.id) AS n, coalesce(sha256(string_agg(p.id || ' ' || p.title, chr(10) ORDER BY p.title, p.id)), sha256('')) AS papers FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l ON l.l_suppkey = s_suppkey LEFT JOIN papers p ON p.id = l.l_orderkey GROUP BY 1")
def topic_nodes(spark, sf):
    topics = M.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("label"), F.lit(0).alias("paper_count"))
    links = M.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic_id"), F.col("l_orderkey").alias("paper_id")).distinct()
    out = lookups.topic_nodes(topics, links, M.papers(spark, sf))
    return out.select("id", F.size("papers").cast("long").alias("n"), X.text_hash(F.array_join(F.transform("papers", lambda p: F.concat(p["id"].cast("string"), F.lit(" "), p["title"])), "\n")).alias("papers"))


@query("SELECT tag FROM (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'Tag ' ELSE 'tag ' END || o_custkey AS tag FROM orders) ORDER BY lower(tag), tag LIMIT 100")
def existing_tags(spark, sf):
    tags = M.table(spark, sf, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Tag ").otherwise("tag "), F.col("o_custkey").cast("string")).alias("tag"))
    return library.existing_tags(tags)


@query("SELECT doc_id AS id, coalesce((SELECT string_split(p.text, chr(10))[1] FROM documents p WHERE p.doc_id = d.doc_id * 2), 'Untitled') AS title FROM documents d")
def hits_with_titles(spark, sf):
    chunks = M.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("paper_id"))
    return search.hits(chunks, M.papers(spark, sf)).select("id", "title")


@query(
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)
SELECT l_orderkey AS selection_id, string_agg(id::VARCHAR, ',' ORDER BY l_linenumber DESC) AS ids FROM s GROUP BY 1"""
)
def selection_rects(spark, sf):
    one = M.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).distinct()
    rect = F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    selections = one.groupBy(F.col("l_orderkey").alias("selection_id")).agg(F.sort_array(F.collect_list("id"), False).alias("sentence_ids"))
    out = lookups.rects_of(selections, one.select("id", F.array(rect).alias("rects")))
    return out.select("selection_id", F.array_join(F.transform("rects", lambda r: r["x"].cast("long").cast("string")), ",").alias("ids"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem EXCEPT SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey % 3 > 0")
def translation_incomplete(spark, sf):
    s = M.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey")
    answers = s.where("l_partkey % 3 <> 1 or l_partkey % 3 = 1").select("id", F.when(F.col("l_partkey") % 3 == 0, "  ").otherwise("x").alias("text"))
    return translation.incomplete(s.select("id").distinct(), answers)


@query("SELECT doc_id, 0 AS segment_no, upper(lang) AS translated, lang AS original FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 2, 'x', source FROM documents WHERE doc_id % 3 <> 1")
def translation_answers(spark, sf):
    doc = M.table(spark, sf, "documents")
    pair = lambda a, b: F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('",null]'))
    js = F.when(F.col("doc_id") % 3 == 1, "{}").otherwise(F.concat(F.lit("[["), pair(F.upper("lang"), F.col("lang")), F.lit(',["only"],'), pair(F.lit("x"), F.col("source")), F.lit('],null,"en"]')))
    out = records.translation_segments(doc.select("doc_id", js.alias("json")))
    return out.select("doc_id", F.col("segment_no").cast("int").alias("segment_no"), "translated", "original")


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN (s = 429 OR s >= 500) AND a < 3 THEN least(30, greatest(1, coalesce(r, 2 ** a)))::BIGINT END AS wait FROM (SELECT l_orderkey, l_linenumber, [200, 429, 404, 503][l_partkey % 4 + 1] AS s, l_suppkey % 4 + 1 AS a, CASE WHEN l_partkey % 5 = 0 THEN l_suppkey END AS r FROM lineitem)")
def retry_waits(spark, sf):
    rows = M.table(spark, sf, "lineitem")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 429, 404, 503)]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), records.retry_wait(status, F.col("l_suppkey") % 4 + 1, F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey"))).alias("wait"))


@query(
    "WITH files AS (SELECT doc_id, '%PDF-' || text || ' %%EOF' AS c FROM documents), o AS (SELECT doc_id, sha256(c) AS sha, row_number() OVER (PARTITION BY sha256(c) ORDER BY doc_id) AS n FROM files)\nSELECT doc_id, sha FROM o WHERE n = 1"
)
def files_copied(spark, sf):
    """Files imported into an empty library: each content is copied once, under its hash."""
    from sparkfolio.session import stage_path

    content = F.concat(F.lit("%PDF-"), "text", F.lit(" %%EOF")).cast("binary")
    files = M.table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), content.alias("content"))
    nothing = files.where("false").select(F.lit("").alias("sha256"), F.lit("").alias("id"))
    out = importing.copied(files, importing.outcomes(files, nothing), stage_path(spark, "library"))
    return out.select(F.col("path").cast("long").alias("doc_id"), F.regexp_extract("target", "([0-9a-f]{64})[.]pdf$", 1).alias("sha"))


# -- jobs, topics -----------------------------------------------------------------------------------------------------


@query(
    with_("jobs")
    + """SELECT id, CASE WHEN id % 3 = 0 AND status IN ('failed', 'waiting_for_key') THEN 'queued' WHEN id % 3 = 1 AND status IN ('queued', 'waiting_for_key') THEN 'cancelled' ELSE status END AS status,
 CASE WHEN id % 3 = 0 AND status IN ('failed', 'waiting_for_key') THEN 0 ELSE attempts END AS attempts FROM jobs"""
)
def jobs_retried_and_cancelled(spark, sf):
    jobs = M.jobs(spark, sf)
    out = queue.cancelled(queue.retried(jobs, jobs.where("id % 3 = 0")), jobs.where("id % 3 = 1"))
    return with_long(out.select("id", "status", "attempts"), "attempts")


@query(
    """WITH d AS (SELECT DISTINCT o_custkey AS p, ['extract', 'thumbnail', 'embed', 'analyze', 'relations'][o_orderkey % 5 + 1] AS kind FROM orders),
n AS (SELECT DISTINCT p, unnest(CASE WHEN kind = 'extract' THEN ['embed', 'analyze'] WHEN kind IN ('embed', 'analyze') THEN ['relations'] ELSE [] END) AS kind FROM d)
SELECT p AS paper_id, kind FROM n WHERE NOT (kind = 'analyze' AND p % 2 = 0)"""
)
def next_kinds(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("extract", "thumbnail", "embed", "analyze", "relations")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    done = M.table(spark, sf, "orders").select(F.col("o_custkey").alias("paper_id"), kind.alias("kind"))
    return queue.next_kinds(done, done.where("paper_id % 2 = 0").select("paper_id").distinct()).select("paper_id", "kind")


_MERGED = "m AS (SELECT s_suppkey AS tag_id, s_suppkey // 3 * 3 + CASE WHEN s_suppkey // 3 = 0 THEN 1 ELSE 0 END AS keep_id FROM supplier)"


def _merged(spark, sf):
    return M.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.expr("s_suppkey div 3 * 3 + case when s_suppkey div 3 = 0 then 1 else 0 end").alias("keep_id"))


@query("WITH " + _MERGED + " SELECT DISTINCT keep_id AS tag_id, l_orderkey AS paper_id FROM lineitem JOIN m ON m.tag_id = l_suppkey")
def tags_merged(spark, sf):
    tags = M.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tag_id"), F.col("l_orderkey").alias("paper_id"))
    return graphs.merge_tags(tags, _merged(spark, sf))


@query(
    "WITH " + _MERGED + """, n AS (SELECT l_suppkey AS tag_id, l_orderkey AS paper_id, max(l_partkey) AS updated_at FROM lineitem GROUP BY ALL), x AS (SELECT m.keep_id, n.*, n.tag_id = m.keep_id AS own FROM n JOIN m USING (tag_id)),
r AS (SELECT keep_id AS tag_id, paper_id, updated_at, row_number() OVER (PARTITION BY keep_id, paper_id ORDER BY updated_at DESC, own DESC) AS rn FROM x) SELECT tag_id, paper_id, updated_at FROM r WHERE rn = 1"""
)
def duplicate_tags_folded(spark, sf):
    notes = M.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tag_id"), F.col("l_orderkey").alias("paper_id")).agg(F.max("l_partkey").alias("updated_at"))
    folded, _ = upserts.fold_duplicates(notes, notes.select("tag_id", "paper_id"), _merged(spark, sf))
    return folded.select("tag_id", "paper_id", "updated_at")


_TOPICS = """e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), s AS (SELECT label, pos, sum(x) AS x FROM e GROUP BY ALL),
v AS (SELECT label AS id, list(x ORDER BY pos) AS v FROM s GROUP BY 1), u AS (SELECT id, [y / sqrt(list_inner_product(v, v)) FOR y IN v] AS v FROM v),
mem AS (SELECT DISTINCT label::BIGINT AS tag_id, vec_id // 2 AS paper_id FROM embeddings),
co AS (SELECT a.tag_id AS a, b.tag_id AS b, count(*)::DOUBLE AS w FROM mem a JOIN mem b USING (paper_id) WHERE a.tag_id < b.tag_id AND paper_id % 7 = 0 GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS w FROM u a, u b WHERE a.id < b.id),
ap AS (SELECT * FROM p WHERE w >= -0.05 AND (a, b) NOT IN (SELECT (a, b) FROM co)),
bo AS (SELECT a AS x, b AS y, w FROM ap UNION ALL SELECT b, a, w FROM ap), best AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(w, 12) DESC, y) AS rank FROM bo QUALIFY rank <= 4)"""


def _memberships(spark, sf):
    e = M.table(spark, sf, "embeddings")
    return e.select(F.col("label").cast("long").alias("tag_id"), F.expr("vec_id div 2").alias("paper_id")).distinct()


def _topic_vectors(spark, sf):
    return blocks.mean_vectors(M.table(spark, sf, "embeddings"), "label", "embedding").withColumnRenamed("label", "id")


@query("WITH " + _TOPICS + " SELECT a, b, 'cooccurrence' AS kind, w AS weight FROM co UNION ALL SELECT DISTINCT least(x, y), greatest(x, y), 'semantic', round(w, 6) FROM best")
def topic_graph_edges(spark, sf):
    """Topics that share a paper, and similar ones that don't."""
    out = graphs.topic_edges(_memberships(spark, sf).where("paper_id % 7 = 0"), _topic_vectors(spark, sf), -0.05, 4)
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "kind", F.round("weight", 6).alias("weight"))


@query("WITH " + _TOPICS.replace(" AND paper_id % 7 = 0", "") + " SELECT a, b, 'cooccurrence' AS kind, w AS weight FROM co UNION ALL SELECT DISTINCT least(x, y), greatest(x, y), 'semantic', round(w, 6) FROM best")
def topics_refreshed(spark, sf):
    """Edges of topics built while two tags lacked papers and another was absent, then refreshed: only pairs of these three are counted anew."""
    from sparkfolio.session import stage_path

    folder, vectors = stage_path(spark, "topics"), _topic_vectors(spark, sf)
    rows = _memberships(spark, sf).select("tag_id", F.col("tag_id").cast("string").alias("label"), "paper_id")
    for state in (rows.where("not (tag_id < 2 and paper_id % 2 = 0) and tag_id <> 3"), rows):
        graphs.refreshed_topics(state, vectors, folder, -0.05, 4)
    return graphs.topic_table(spark, folder).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "kind", F.round("weight", 6).alias("weight"))


@query("WITH mem AS (SELECT label AS tag_id, count(DISTINCT vec_id // 2) AS n FROM embeddings GROUP BY 1) SELECT FALSE AS again, TRUE AS after_change, tag_id::BIGINT AS tag_id, n AS n_papers FROM mem")
def topics_rebuilt(spark, sf):
    """Topics written, not written again while nothing changed, and again after a change; then as the first time."""
    from sparkfolio.session import stage_path
    from sparkfolio.sources import versions

    folder, vectors = stage_path(spark, "topics"), _topic_vectors(spark, sf)
    rows = _memberships(spark, sf).select("tag_id", F.col("tag_id").cast("string").alias("label"), F.lit("user").alias("source"), "paper_id")
    graphs.rebuilt_topics(rows, vectors, folder)
    again = graphs.rebuilt_topics(rows, vectors, folder)
    changed = graphs.rebuilt_topics(rows.where("paper_id % 2 = 0"), vectors, folder)
    graphs.rebuilt_topics(rows, vectors, folder)
    return versions.opened(spark, folder).table("topics").select(F.lit(again).alias("again"), F.lit(changed).alias("after_change"), "tag_id", "n_papers")


@query(
    """WITH n AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
e AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y, count(*) AS w FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_orderkey % 20 = 0) a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_orderkey % 20 = 0) b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)
SELECT id, NULL::BIGINT AS other, round(16 + 30 * n / (SELECT greatest(1, max(n)) FROM n), 6) AS size, row_number() OVER (ORDER BY id) - 1 AS place FROM n
UNION ALL SELECT x, y, round(1 + 3 * w / (SELECT greatest(1, max(w)) FROM e), 6), NULL FROM e"""
)
def graph_layout(spark, sf):
    """Suppliers by their orders, and lines between those that share an order of a twentieth of all."""
    lines = M.table(spark, sf, "lineitem")
    nodes = lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("n_papers"))
    edges = graphs.cooccurrence(lines.where("l_orderkey % 20 = 0"), "l_suppkey", "l_orderkey")
    sized, wide = graphs.layout(nodes, edges)
    placed = sized.select("id", F.lit(None).cast("long").alias("other"), F.round("size", 6).alias("size"), F.round((F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 1600).cast("long").alias("place"))
    return placed.unionByName(wide.select(F.col("a").alias("id"), F.col("b").alias("other"), F.round("width", 6).alias("size"), F.lit(None).cast("long").alias("place")))


# -- scalar functions -------------------------------------------------------------------------------------------------

_SMALL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _text_lines(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "line")


@query("WITH " + _SMALL + r""" SELECT doc_id, i, regexp_matches(rtrim(line), '[.!?。！？…]["'')\]”’]*$') AS ends FROM l""")
def sentence_ends(spark, sf):
    return _text_lines(spark, sf).select("doc_id", "i", X.ends_sentence(F.col("line")).alias("ends"))


@query("SELECT doc_id, '{\"a\": ' || doc_id || '}' AS json FROM documents")
def code_fences(spark, sf):
    body = F.concat(F.lit('{"a": '), F.col("doc_id"), F.lit("}"))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" ```\n"), body, F.lit("```"))).otherwise(F.concat(body, F.lit("\n")))
    return M.table(spark, sf, "documents").select("doc_id", X.strip_code_fence(fenced).alias("json"))


@query("SELECT doc_id, '#' || lang || '-' || source AS tag, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' (' || array_to_string([(doc_id + g)::VARCHAR || 'p' FOR g IN range(doc_id % 3)], ', ') || ')' END AS pages FROM documents")
def hashtags_and_pages(spark, sf):
    pages = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<bigint>")).when(F.col("doc_id") % 3 == 1, F.array("doc_id")).otherwise(F.array(F.col("doc_id"), F.col("doc_id") + 1))
    return M.table(spark, sf, "documents").select("doc_id", X.hashtag(F.concat_ws(" ", "lang", "source")).alias("tag"), X.page_links(pages).alias("pages"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' ELSE lang END AS language FROM documents")
def language_names(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", X.language_name(F.col("lang")).alias("language"))


@query("SELECT doc_id, round(ln((0.1 + doc_id % 40 / 10.0) / 0.1) / ln(40.0), 6) AS slider, round(0.1 + doc_id % 40 / 10.0, 6) AS zoom FROM documents")
def zoom_scale(spark, sf):
    zoom = 0.1 + (F.col("doc_id") % 40) / 10.0
    slider = X.zoom_to_slider(zoom)
    return M.table(spark, sf, "documents").select("doc_id", F.round(slider, 6).alias("slider"), F.round(X.slider_to_zoom(slider), 6).alias("zoom"))


@query("SELECT event_id, strftime(ts + to_seconds(event_id % 7200 - 3600), '%Y-%m-%dT%H:%M:%S.%gZ') AS later FROM events")
def times_shifted(spark, sf):
    later = X.plus_seconds(F.col("ts").cast("timestamp"), F.col("event_id") % 7200 - 3600)
    return M.table(spark, sf, "events").select("event_id", X.iso8601(later).alias("later"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM documents),
k AS (SELECT doc_id, i, regexp_replace(w, '[^\p{L}\p{N}_-]', '', 'g') AS t FROM w WHERE regexp_matches(w, '[\p{L}\p{N}]')) SELECT doc_id, sha256(string_agg(t, ' ' ORDER BY i)) AS terms FROM k GROUP BY 1"""
)
def question_terms(spark, sf):
    out = M.table(spark, sf, "documents").select("doc_id", search.chunk_terms(F.col("text")).alias("terms"))
    return out.where("size(terms) > 0").select("doc_id", X.text_hash(F.array_join("terms", " ")).alias("terms"))


# -- analyses and notes -----------------------------------------------------------------------------------------------

_ANSWER = """{"schemaVersion": "%s", "shortSummary": "%s", "detailedSummary": "d", "researchProblem": "r", "contributions": [{"claim": "c", "evidencePages": [3, 1, 99, 3]}], "methodology": "m", "results": [], "limitations": [],
"keywords": [" ", "k"], "suggestedTags": ["Alpha", "a tag of far too many words to be one"], "tagInsights": [{"tag": "ALPHA", "insight": "x", "evidencePages": [1]}, {"tag": "Beta", "insight": "y"}], "followUpQuestions": []}"""


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'schema' WHEN 2 THEN 'version' WHEN 3 THEN 'empty summary' END AS error, CASE WHEN doc_id % 5 IN (0, 4) THEN 'Alpha,Beta' END AS tags,
 CASE WHEN doc_id % 5 IN (0, 4) THEN CASE WHEN doc_id % 4 >= 2 THEN '1,3' ELSE '1' END END AS pages, CASE WHEN doc_id % 5 IN (0, 4) THEN 'k' END AS keywords FROM documents"""
)
def analyses_validated(spark, sf):
    """Answers that are valid, lack fields, have another version, say nothing, or stand in a fenced block."""
    kind = F.col("doc_id") % 5
    js = F.when(kind == 1, '{"schemaVersion": "1"}').when(kind == 2, _ANSWER % ("0", "s")).when(kind == 3, _ANSWER % ("1", "  ")).when(kind == 4, "```json\n" + _ANSWER % ("1", "s") + "\n```").otherwise(_ANSWER % ("1", "s"))
    rows = M.table(spark, sf, "documents").select("doc_id", js.alias("json"), (F.col("doc_id") % 4 + 1).alias("page_count"))
    out = analysis.validate(rows)
    pages = F.array_join(F.col("analysis.contributions")[0]["evidencePages"].cast("array<string>"), ",")
    return out.select("doc_id", "error", F.array_join("analysis.suggestedTags", ",").alias("tags"), pages.alias("pages"), F.array_join("analysis.keywords", ",").alias("keywords"))


@query(
    """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 <> 1 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 4 <> 1 THEN source || ',' || 'all' END AS groups, CASE WHEN doc_id % 4 <> 1 THEN lang END AS tags,
 CASE WHEN doc_id % 4 <> 1 THEN 'my ' || lang END AS user_text, CASE WHEN doc_id % 4 = 1 THEN 'unbalanced managed markers' END AS error FROM documents"""
)
def notes_parsed(spark, sf):
    """Notes with frontmatter, a generated and a user's block; one in four is damaged, and says nothing of itself here."""
    end = F.when(F.col("doc_id") % 4 == 1, "").otherwise("<!-- managed:end -->")
    content = F.concat(F.lit('---\npaper_id: "'), F.col("doc_id"), F.lit('"\ngroups:\n  - "'), "source", F.lit('"\n  - all\ntags:\n  - '), "lang", F.lit("\nother: x\n---\nabove\n<!-- managed:start -->\nbody\n"), end, F.lit("\n<!-- user:start -->\nmy "), "lang", F.lit("\n<!-- user:end -->\nbelow\n"))
    out = notes.parsed_notes(M.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    good = F.col("error").isNull()
    return out.select("path", F.when(good, F.col("id")).alias("id"), F.when(good, F.array_join("groups", ",")).alias("groups"), F.when(good, F.array_join("tags", ",")).alias("tags"), F.when(good, F.col("user")).alias("user_text"), "error")


@query(
    """WITH p AS (SELECT id, string_agg('- [[' || t || ']]', chr(10) ORDER BY t) AS papers FROM (SELECT DISTINCT l_suppkey AS id, 'T' || l_orderkey AS t FROM lineitem) GROUP BY 1)
SELECT s_suppkey AS id, sha256('# s' || s_suppkey || chr(10) || chr(10) || '## Topics' || chr(10) || chr(10) || '- [[s' || (s_suppkey - 1) || ']]' || chr(10) || '- [[s' || (s_suppkey + 1) || ']]'
 || coalesce(chr(10) || chr(10) || '## Papers' || chr(10) || chr(10) || papers, '') || chr(10)) AS content FROM supplier LEFT JOIN p ON p.id = s_suppkey"""
)
def topic_notes(spark, sf):
    topics = M.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("label"))
    name = lambda d: F.concat(F.lit("s"), F.col("id") + d)
    papers = M.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("T"), "l_orderkey").alias("title")).distinct()
    out = notes.topic_notes(topics, topics.select("id", F.array(name(-1), name(1)).alias("neighbours")), papers)
    return out.select("id", X.text_hash(F.col("content")).alias("content"))


@query(
    """WITH p AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line FROM documents),
now AS (SELECT paper_id, count(*) AS n FROM p WHERE paper_id % 10 <> 3 AND paper_id % 10 <> 7 GROUP BY 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 10 = 7)
SELECT a.paper_id, a.n AS lines_before, n.n AS lines_now, CASE WHEN n.n IS NOT NULL THEN 1 END AS papers_now
FROM (SELECT paper_id, count(*) AS n FROM p GROUP BY 1) a LEFT JOIN now n USING (paper_id)"""
)
def committed_together(spark, sf):
    """Two tables changed in one commit: lines of some papers replaced, other papers gone from both; and what was read before."""
    from sparkfolio.session import stage_path
    from sparkfolio.sources import versions
    from sparkfolio.sources.versions import Change

    docs = M.table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    first = versions.commit(versions.opened(spark, stage_path(spark, "library")), {"papers": Change("paper_id", docs.select(F.col("doc_id").alias("paper_id"), "source")), "lines": Change("paper_id", lines)})
    gone = docs.where("doc_id % 10 = 3").select(F.col("doc_id").alias("paper_id"))
    again = docs.where("doc_id % 10 = 7").select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("no"), F.lit("anew").alias("line"))
    second = versions.commit(first, {"papers": Change("paper_id", replaced=gone), "lines": Change("paper_id", again, replaced=gone)})
    count = lambda s, t, name: s.table(t).groupBy("paper_id").agg(F.count("*").alias(name))
    return count(first, "lines", "lines_before").join(count(second, "lines", "lines_now"), "paper_id", "left").join(count(second, "papers", "papers_now"), "paper_id", "left")

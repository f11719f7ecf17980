"""Page geometry: glyph items to lines, columns, paragraphs and titles; rectangles merged, cut and clipped.

Pages are small and independent.  What is an aggregate or a window stays one; what depends on the order in which items
join lines (first fit) runs per page on Arrow tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import groupby
from statistics import median_high

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import ends_sentence
from sparkfolio.operators.documents import sentence_ranges

LINE_TOLERANCE, FOOT_TOP, FOOT_RATIO, TITLE_BOTTOM, TITLE_RATIO, TITLE_PROMINENCE, SHORT_MARGIN, PARAGRAPH_GAP = 0.6, 0.88, 0.85, 0.5, 0.9, 1.15, 0.12, 1.6

#: Items: paper_id, page_number, item_no, text, x, y, width, height (fractions of the page), baseline, height_pt, left_pt.
PAGE = ["paper_id", "page_number"]


def upper_median(value: Column) -> Column:
    """The middle value, or the upper of two."""
    ordered = F.sort_array(F.collect_list(value))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def footnotes(items: DataFrame) -> DataFrame:
    """Items with ``is_footnote``: in the band at the page's foot and set smaller than the page's median."""
    shown = F.when(F.trim("text") != "", F.col("height"))
    middle = items.groupBy(*PAGE).agg(upper_median(shown).alias("_m"))
    marked = items.join(middle, PAGE, "left")
    small = (F.col("y") >= FOOT_TOP) & (F.col("height") < F.col("_m") * FOOT_RATIO)
    return marked.withColumn("is_footnote", F.coalesce(small, F.lit(False))).drop("_m")


def column_gutters(items: DataFrame, least_items: int = 12) -> DataFrame:
    """Rows (page, gutter): where a second column starts, judged by left edges: both sides hold a quarter of the items and the
    band left of the candidate is the emptiest, and nearly empty."""
    content, tries, x = items.where(F.trim("text") != ""), [i / 100.0 for i in range(42, 63)], F.col("x")
    bands = [F.count_if((x >= F.lit(g) - 0.045) & (x < F.lit(g) - 0.005)).alias(f"band{k}") for k, g in enumerate(tries)]
    sums = content.groupBy(*PAGE).agg(F.count("*").alias("n"), *bands, *[F.count_if(x < g).alias(f"left{k}") for k, g in enumerate(tries)]).where(F.col("n") >= least_items)
    tried = F.array(*[F.struct(F.col(f"band{k}").alias("band"), F.lit(g).alias("gutter"), F.col(f"left{k}").alias("left")) for k, g in enumerate(tries)])
    ok = F.filter(tried, lambda t: (t["left"] >= F.col("n") * 0.25) & (F.col("n") - t["left"] >= F.col("n") * 0.25))
    best = sums.select(*PAGE, "n", F.array_min(ok).alias("b"))
    return best.where(F.col("b.band") < F.col("n") * 0.03).select(*PAGE, F.col("b.gutter").alias("gutter"))


def reading_columns(items: DataFrame) -> DataFrame:
    """Items with their column: 0 or left, 1 right, 2 footnotes; blank items go only where there are two columns."""
    marked = footnotes(items)
    gutters = column_gutters(marked.where("not is_footnote"))
    placed = marked.join(gutters, PAGE, "left").where("is_footnote or gutter is null or trim(text) <> ''")
    return placed.withColumn("column", F.when(F.col("is_footnote"), 2).when(F.col("gutter").isNull() | (F.col("x") < F.col("gutter")), 0).otherwise(1)).drop("gutter")


def _per_page(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = {name: kinds[kind] for name, kind in (s.split(" ") for s in schema.split(", "))}

    def run(rows: list[dict]) -> list[tuple]:
        return [tuple(r[n] for n in fields) for r in fn(rows)]

    return _by_page(df, keys, run, fields, schema)


#: Rows that a Python worker turns into objects at a time, beside those of one page.
SLICE = 2_000


def _by_page(df: DataFrame, keys: list[str], run: Callable[[list[dict]], list[tuple]], fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """What ``run`` makes of the rows of each page. Pages are small, so a call takes many of them: rows stand in the order of
    their pages, and one that a batch ends in goes on in the next."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(fields.values())], names=list(fields))

        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out: list[tuple] = []
                for page, rows in groupby(batch.slice(at, SLICE).to_pylist(), key=lambda r: tuple(r[k] for k in keys)):
                    if held and tuple(held[0][k] for k in keys) != page:
                        out += run(held)
                        held = []
                    held += rows
                yield made(out)
        if held:
            yield made(run(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def first_fit(items: list[dict], same: Callable[[dict, dict], bool], join: Callable[[dict, dict], None]) -> list[dict]:
    """Groups in order of their first items: each item joins the first group it fits."""
    groups: list[dict] = []
    for item in items:
        group = next((g for g in groups if same(g, item)), None)
        if group is None:
            groups.append(dict(item))
        else:
            join(group, item)
    return groups


def lines_of(items: list[dict]) -> list[dict]:
    """Lines of a column: items whose baselines lie within part of an item's height, each line by x, lines from the top."""
    start = [{"baseline": i["baseline"], "items": [i]} for i in sorted(items, key=lambda i: i["item_no"])]
    lines: list[dict] = []
    placed: list[tuple[float, int]] = []  # baselines of lines, which don't move, with their numbers
    for one in start:
        base, reach = one["baseline"], one["items"][0]["height_pt"] * LINE_TOLERANCE
        fit = len(lines)
        for k in range(bisect_left(placed, (base - reach * 1.01 - 1e-6, -1)), len(placed)):
            if placed[k][0] - base > reach:
                break
            if abs(placed[k][0] - base) <= reach:
                fit = min(fit, placed[k][1])
        if fit == len(lines):
            insort(placed, (base, fit))
            lines.append(dict(one))
        else:
            lines[fit]["items"].append(one["items"][0])
    for line in lines:
        line["items"] = sorted(line["items"], key=lambda i: i["left_pt"])
        line["text"] = "".join(i["text"] for i in line["items"]).strip()
        line["right"] = max(i["x"] + i["width"] for i in line["items"])
        line["size"] = max(i["height"] for i in line["items"])
        line["height_pt"] = max(i["height_pt"] for i in line["items"])
    return sorted(lines, key=lambda x: x["baseline"])


LINES = "paper_id long, page_number long, column int, line_no long, text string, baseline double, right double, size double, height_pt double"


def page_lines(items: DataFrame) -> DataFrame:
    """Lines of pages in reading order."""

    def run(rows: list[dict]) -> list[dict]:
        return [{k: rows[0][k] for k in ("paper_id", "page_number", "column")} | {"line_no": n} | {k: x[k] for k in ("text", "baseline", "right", "size", "height_pt")} for n, x in enumerate(lines_of(rows))]

    return _per_page(reading_columns(items), [*PAGE, "column"], run, LINES)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with the number of their paragraph in their column: it ends before a wide gap and after a short line that ends a
    sentence."""
    column = Window.partitionBy(*PAGE, "column")
    w = column.orderBy("line_no")
    gap = F.lead("baseline").over(w) - F.col("baseline")
    short = F.col("right") < F.max("right").over(column) - SHORT_MARGIN
    ends = (gap > F.col("height_pt") * PARAGRAPH_GAP) | (short & ends_sentence(F.col("text")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return lines.where("text <> ''").withColumn("_ends", ends.cast("int")).withColumn("paragraph", F.coalesce(F.sum("_ends").over(before), F.lit(0)).cast("long")).drop("_ends")


def joined_lines(texts: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """A paragraph's text with words put together again that a hyphen parted at a line's end, and each line's range in it."""
    out, ranges = "", []
    for i, text in enumerate(texts):
        start = len(out)
        out += text
        ranges.append((start, len(out)))
        if i + 1 < len(texts):
            bare = out.rstrip()
            if bare[-1:] in ("-", "­") and re.match("[a-z]", texts[i + 1].lstrip()):
                out = bare[:-1]
                ranges[-1] = (start, min(ranges[-1][1], len(out)))
            else:
                out += " "
    return out, ranges


def paragraph_texts(lines: DataFrame) -> DataFrame:
    def run(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: r["line_no"])
        return [{k: rows[0][k] for k in ("paper_id", "page_number", "column", "paragraph")} | {"text": joined_lines([r["text"] for r in rows])[0]}]

    return _per_page(paragraphs(lines), [*PAGE, "column", "paragraph"], run, "paper_id long, page_number long, column int, paragraph long, text string")


SENTENCES = "paper_id long, page_number long, order_index long, paragraph_index long, text string, rects array<struct<x:double,y:double,width:double,height:double>>"


def paragraph_pieces(lines: list[dict]) -> tuple[str, list[tuple[int, int, dict]]]:
    """A paragraph's text, as ``joined_lines`` has it, and the range of each item in it."""
    text, pieces = "", []
    for n, line in enumerate(lines):
        for item in line["items"]:
            pieces.append((len(text), len(text) + len(item["text"]), item))
            text += item["text"]
        if n + 1 < len(lines):
            bare = text.rstrip()
            if bare[-1:] in ("-", "­") and re.match("[a-z]", "".join(i["text"] for i in lines[n + 1]["items"]).lstrip()):
                text = bare[:-1]
                start, end, item = pieces[-1]
                pieces[-1] = (start, min(end, len(text)), item)
            else:
                text += " "
    return text, pieces


def paragraphs_of(lines: list[dict]) -> Iterator[list[dict]]:
    """Lines of a column in paragraphs, which end where ``paragraphs`` ends them."""
    widest, held = max((x["right"] for x in lines), default=0.0), []
    for line, after in zip(lines, [*lines[1:], None]):
        held.append(line)
        gap = after is None or after["baseline"] - line["baseline"] > line["height_pt"] * PARAGRAPH_GAP
        if gap or (line["right"] < widest - SHORT_MARGIN and re.search(r"""[.!?。！？…]["')\]”’]*$""", line["text"].rstrip())):
            yield held
            held = []


def extracted(items: DataFrame) -> DataFrame:
    """Sentences of pages from their glyph items: columns in reading order, lines, paragraphs with words put together again,
    sentences, and for each the rectangles of its items, one per line. Pages are independent: one is read by one task."""
    columns = reading_columns(items)

    def run(rows: list[dict]) -> list[tuple]:
        out, paragraph = [], 0
        for column in sorted({r["column"] for r in rows}):
            lines = [x for x in lines_of([r for r in rows if r["column"] == column]) if x["text"]]
            for held in paragraphs_of(lines):
                text, pieces = paragraph_pieces(held)
                before = len(out)
                for start, end in sentence_ranges(text):
                    rects = [{k: i[k] for k in ("x", "y", "width", "height")} for a, b, i in pieces if b > start and a < end]
                    if text[start:end].strip() and rects:
                        out.append((rows[0]["paper_id"], rows[0]["page_number"], len(out), paragraph, text[start:end].strip(), merge_rects(rects)))
                paragraph += len(out) > before
        return out

    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")]))]
    return _by_page(columns, PAGE, run, dict(zip(("paper_id", "page_number", "order_index", "paragraph_index", "text", "rects"), kinds)), SENTENCES)


def layout_titles(items: DataFrame) -> DataFrame:
    """Rows (paper_id, title): the first run of lines in nearly the largest size of a first page's upper half, if it stands
    out from the page's median."""

    def run(rows: list[dict]) -> list[dict]:
        shown = [r for r in rows if r["text"].strip()]
        if not shown:
            return []
        middle = median_high(r["height"] for r in shown)
        lines = [x for x in lines_of([r for r in shown if r["y"] < TITLE_BOTTOM]) if len(x["text"]) >= 4 and re.search(r"[^\W\d_]", x["text"])]
        largest = max((x["size"] for x in lines), default=0)
        if not lines or largest < middle * TITLE_PROMINENCE:
            return []
        big = [x["size"] >= largest * TITLE_RATIO for x in lines]
        first = big.index(True)
        end = next((i for i in range(first, len(big)) if not big[i]), len(big))
        return [{"paper_id": rows[0]["paper_id"], "title": " ".join(x["text"] for x in lines[first:end])}]

    return _per_page(items.where("page_number = 1"), ["paper_id"], run, "paper_id long, title string")


# -- rectangles -------------------------------------------------------------------------------------------------------


def merge_rects(rects: list[dict]) -> list[dict]:
    """One rectangle per visual line."""

    def same(g: dict, r: dict) -> bool:
        return abs(g["y"] - r["y"]) < r["height"] / 2 and abs(g["height"] - r["height"]) < r["height"] / 2

    def join(g: dict, r: dict) -> None:
        right, bottom = max(g["x"] + g["width"], r["x"] + r["width"]), max(g["y"] + g["height"], r["y"] + r["height"])
        g["x"], g["y"] = min(g["x"], r["x"]), min(g["y"], r["y"])
        g["width"], g["height"] = right - g["x"], bottom - g["y"]

    return first_fit(rects, same, join)


def merge_bars(boxes: list[dict], gap_ratio: float = 1.2) -> list[dict]:
    """Boxes (top, bottom, left, right) of one line joined across small gaps; a wide gap starts a new bar."""

    def same(g: dict, b: dict) -> bool:
        height = b["bottom"] - b["top"]
        overlap = min(g["bottom"], b["bottom"]) - max(g["top"], b["top"])
        return overlap > min(g["bottom"] - g["top"], height) / 2 and max(b["left"] - g["right"], g["left"] - b["right"]) <= height * gap_ratio

    def join(g: dict, b: dict) -> None:
        g["left"], g["top"] = min(g["left"], b["left"]), min(g["top"], b["top"])
        g["right"], g["bottom"] = max(g["right"], b["right"]), max(g["bottom"], b["bottom"])

    return first_fit(sorted(boxes, key=lambda b: (b["top"], b["left"])), same, join)


RECTS = "array<struct<x:double,y:double,width:double,height:double>>"


def with_merged_rects(df: DataFrame, rects: str = "rects", out: str = "merged") -> DataFrame:
    """``df`` with the rectangles of each row merged per line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")]))
        for batch in batches:
            merged = [None if r is None else merge_rects(r) for r in batch.column(batch.schema.get_field_index(rects)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(merged, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast(RECTS)).schema)


def _cut_parts(r: Column, cut: Column) -> tuple[Column, Column, Column]:
    """Whether a rectangle lies on the cut's line, and what is left of it on either side."""
    pad = cut["height"] * 0.25
    lo, hi, end = cut["x"] - pad, cut["x"] + cut["width"] + pad, r["x"] + r["width"]
    overlap = F.least(r["y"] + r["height"], cut["y"] + cut["height"]) - F.greatest(r["y"], cut["y"])
    same = overlap > F.least(r["height"], cut["height"]) * 0.4
    left_end, right_start = F.least(F.greatest(lo, r["x"]), end), F.greatest(F.least(hi, end), r["x"])
    piece = lambda x, w: F.struct(x.alias("x"), r["y"].alias("y"), w.alias("width"), r["height"].alias("height"))
    return same, piece(r["x"], left_end - r["x"]), piece(right_start, end - right_start)


MIN_WIDTH = 0.004


def subtract_rect(rects: Column, cut: Column) -> Column:
    """Rectangles without a word's, padded: its line falls into what is left on either side."""

    def parts(r: Column) -> Column:
        same, left, right = _cut_parts(r, cut)
        pad = cut["height"] * 0.25
        apart = ~same | (cut["x"] + cut["width"] + pad <= r["x"]) | (cut["x"] - pad >= r["x"] + r["width"])
        return F.when(apart, F.array(r)).otherwise(F.filter(F.array(left, right), lambda p: p["width"] > MIN_WIDTH))

    return F.flatten(F.transform(rects, parts))


def split_around(rects: Column, cut: Column) -> tuple[Column, Column]:
    """Rectangles before and after a word in reading order."""

    def side(which: int) -> Callable[[Column], Column]:
        def parts(r: Column) -> Column:
            same, left, right = _cut_parts(r, cut)
            above = r["y"] + r["height"] <= cut["y"] + cut["height"] * 0.5
            part = (left, right)[which]
            empty = F.slice(F.array(r), 1, 0)
            return F.when(same, F.when(part["width"] > MIN_WIDTH, F.array(part)).otherwise(empty)).when(above if which == 0 else ~above, F.array(r)).otherwise(empty)

        return parts

    return F.flatten(F.transform(rects, side(0))), F.flatten(F.transform(rects, side(1)))


def clip_to_glyphs(rects: DataFrame, glyphs: DataFrame, gap: float = 0.014) -> DataFrame:
    """Rows (paper_id, page_number, rect_no, island, x, width): a rectangle narrowed to the glyphs on its line that it covers,
    in runs without wide gaps. Rectangles and glyphs meet on their page only."""
    g = glyphs.select(*PAGE, F.struct("x", "y", "width", "height").alias("g"))
    met = rects.select(*PAGE, "rect_no", F.struct("x", "y", "width", "height").alias("r")).join(g, PAGE)
    overlap = F.least(F.col("r.y") + F.col("r.height"), F.col("g.y") + F.col("g.height")) - F.greatest(F.col("r.y"), F.col("g.y"))
    covers = (overlap > 0.4 * F.least("r.height", "g.height")) & (F.col("g.x") < F.col("r.x") + F.col("r.width")) & (F.col("g.x") + F.col("g.width") > F.col("r.x"))
    hit = met.where(covers).select(*PAGE, "rect_no", F.greatest("g.x", "r.x").alias("x0"), F.least(F.col("g.x") + F.col("g.width"), F.col("r.x") + F.col("r.width")).alias("x1"))
    w = Window.partitionBy(*PAGE, "rect_no").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hit.withColumn("_new", F.coalesce((F.col("x0") - reach > gap).cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w).cast("long"))
    return runs.groupBy(*PAGE, "rect_no", "island").agg(F.min("x0").alias("x"), (F.max("x1") - F.min("x0")).alias("width"))


def word_at(items: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (point_id, text, x, width): the word of an item under a point, by the item's mean character width."""
    met = points.select(*PAGE, "point_id", F.col("px"), F.col("py")).join(items, PAGE)
    inside = F.col("px").between(F.col("x"), F.col("x") + F.col("width")) & F.col("py").between(F.col("y"), F.col("y") + F.col("height"))
    hit = met.where(inside & (F.length("text") > 0)).withColumn("char", F.col("width") / F.length("text"))
    hit = hit.withColumn("at", F.least(F.floor((F.col("px") - F.col("x")) / F.col("char")), F.length("text") - 1).cast("int"))
    hit = hit.withColumn("head", F.regexp_extract(F.expr("substring(text, 1, at + 1)"), r"(\S*)$", 1)).withColumn("tail", F.regexp_extract(F.expr("substring(text, at + 2)"), r"^(\S*)", 1))
    hit = hit.where("head <> ''").withColumn("word", F.concat("head", "tail")).withColumn("from", F.expr("at + 1 - length(head)"))
    first = F.row_number().over(Window.partitionBy("point_id").orderBy("item_no"))
    return hit.withColumn("_r", first).where("_r = 1").select("point_id", F.col("word").alias("text"), (F.col("x") + F.col("from") * F.col("char")).alias("x"), (F.length("word") * F.col("char")).alias("width"))


def glyph_rect(transform: Column, width: Column, page_width: Column, page_height: Column) -> Column:
    """A glyph run's rectangle in page fractions from its text matrix [a, b, c, d, e, f] (y up) and advance width."""
    height = F.sqrt(transform[2] * transform[2] + transform[3] * transform[3])
    return F.struct((transform[4] / page_width).alias("x"), (1 - (transform[5] + height) / page_height).alias("y"), (width / page_width).alias("width"), (height / page_height).alias("height"))

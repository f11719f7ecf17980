"""Documents as pages, lines, sentences, sections and chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import HEADINGS, MAX_HEADING_BYTES, MAX_HEADING_WORDS, normalize_running

TARGET, OVERLAP, LIMIT = 420, 60, 480
FULL_BYTES, SIDE_BYTES = 120_000, 40_000


def page_table(docs: DataFrame, lines_per_page: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (paper_id, page_number, text): a text cut into pages of so many lines, without a shuffle."""
    lines = F.split(F.col(text_col), "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int")), lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)), "\n"))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("paper_id"), F.posexplode(pages).alias("page", "text")).select("paper_id", (F.col("page") + 1).cast("long").alias("page_number"), "text")


def document_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """Rows (paper_id, text): pages in order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias("text"))


def repeated_lines(pages: DataFrame, least_pages: int = 4, share: float = 0.6, least: int = 3, least_chars: int = 4) -> DataFrame:
    """Rows (paper_id, key, n): masked first or last lines that stand on most of a paper's pages."""
    lines = F.split("text", "\n")
    edges = pages.select("paper_id", "page_number", F.explode(F.array_distinct(F.array(lines[0], F.element_at(lines, -1)))).alias("line"))
    keys = edges.select("paper_id", normalize_running(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    n_pages = pages.groupBy("paper_id").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    counts = keys.groupBy("paper_id", "key").agg(F.count("*").alias("n")).join(n_pages, "paper_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("paper_id", "key", "n")


def without_repeated_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages without the lines whose masked form is repeated."""
    drop = repeated.groupBy("paper_id").agg(F.collect_set("key").alias("_drop"))
    joined = pages.join(drop, "paper_id", "left")
    kept = F.when(F.col("_drop").isNull(), F.split("text", "\n")).otherwise(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_drop"), normalize_running(x))))
    return joined.select("paper_id", "page_number", F.array_join(kept, "\n").alias("text"))


def carried_sections(lines: DataFrame, heading: Column) -> DataFrame:
    """Lines (paper_id, line_no, line) with the last heading at or before them."""
    upto = Window.partitionBy("paper_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(upto))


def char_offsets(units: DataFrame, partition: str, order: str, text: str = "text", separator: int = 1) -> DataFrame:
    """Units with the range [start, end) they take in their joined text, in characters."""
    before = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0)).cast("long")
    return units.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def islands(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Rows with the number of their run of equal neighbouring values, from 0."""
    w = Window.partitionBy(partition).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", F.when(first, 0).otherwise(changed)).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def source_budget(pages: DataFrame, full: int = FULL_BYTES, side: int = SIDE_BYTES, marker: str = "[...]") -> DataFrame:
    """Rows (paper_id, source, pages_used): all pages with their numbers if they fit, else whole pages from either end.

    A page is taken from an end while the bytes taken so far, with page marks, and its own text fit; the first that doesn't
    ends that side.  Running sums over a paper's pages; nothing is looped.
    """
    shown = F.concat(F.lit("[page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text"))
    p = pages.withColumn("shown", shown).withColumn("emitted", F.octet_length("shown") + 2).withColumn("size", F.octet_length("text"))
    forward, backward = Window.partitionBy("paper_id").orderBy("page_number"), Window.partitionBy("paper_id").orderBy(F.col("page_number").desc())

    def taken(w):
        before = F.coalesce(F.sum("emitted").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return before + F.col("size") <= side

    p = p.withColumns({"head_ok": taken(forward), "tail_ok": taken(backward)})
    p = p.withColumns({"head": F.min(F.col("head_ok").cast("int")).over(forward) == 1, "tail": F.min(F.col("tail_ok").cast("int")).over(backward) == 1})
    rows = F.sort_array(F.collect_list(F.struct("page_number", "shown", "head", "tail")))
    per = p.groupBy("paper_id").agg(rows.alias("r"), (F.sum(F.octet_length("shown")) + 2 * (F.count("*") - 1)).alias("total"))
    part = lambda which: F.array_join(F.transform(F.filter("r", lambda x: x[which]), lambda x: F.concat(x["shown"], F.lit("\n\n"))), "")
    whole = F.array_join(F.transform("r", lambda x: x["shown"]), "\n\n")
    fits = F.col("total") <= full
    used = F.when(fits, F.size("r")).otherwise(F.size(F.filter("r", lambda x: x["head"])) + F.size(F.filter("r", lambda x: x["tail"])))
    return per.select("paper_id", F.when(fits, whole).otherwise(F.concat(part("head"), F.lit(f"\n{marker}\n\n"), part("tail"))).alias("source"), used.cast("long").alias("pages_used"))


# -- sentences and chunks ---------------------------------------------------------------------------------------------

_CJK = re.compile("[ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯]")
_SENTENCE_END = re.compile("[.!?。！？]")


def tokens_of(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk - (cjk - len(text)) // 4


def sentences_of(line: str, least_bytes: int = 13) -> list[str]:
    """A line cut after each end mark by which at least so many bytes have gathered; the rest is kept."""
    out, start = [], 0
    for m in _SENTENCE_END.finditer(line):
        piece = line[start : m.end()].strip()
        if len(piece.encode()) >= least_bytes:
            out.append(piece)
            start = m.end()
    rest = line[start:].strip()
    return out + [rest] * bool(rest)


def heading_of(line: str) -> str | None:
    bare = line.strip()
    if not bare or len(bare.encode()) > MAX_HEADING_BYTES:
        return None
    if bare.lower().lstrip("0123456789. ").strip() in HEADINGS:
        return bare
    numbered = bare[0] in "0123456789" and " " in bare and len(bare.split()) <= MAX_HEADING_WORDS
    return bare if numbered else None


@dataclass
class Unit:
    text: str
    page: int
    section: str | None
    tokens: int


def units_of(pages: list[tuple[int, str]]) -> list[Unit]:
    out, section = [], None
    for number, text in pages:
        for line in text.split("\n"):
            line = line.removesuffix("\r")
            if (found := heading_of(line)) is not None:
                section = found
            else:
                out += [Unit(s, number, section, tokens_of(s)) for s in sentences_of(line)]
    return out


def chunks_of(pages: list[tuple[int, str]], suffix_chunks: bool = True, skip_after_oversized: bool = False) -> list[dict]:
    """Chunks of a document: sentences up to the token target within one section, overlapping; a sentence above the limit is
    cut by characters.

    suffix_chunks: a chunk that ended with its section or the document is stepped back from too, which repeats its end in ever
    shorter chunks. skip_after_oversized: the sentence after one that was cut is left out.
    """
    units = units_of(pages)
    out: list[dict] = []

    def add(section: str | None, first: int, last: int, text: str) -> None:
        out.append({"section": section, "page_start": first, "page_end": last, "text": text, "token_count": tokens_of(text), "content_hash": hashlib.sha256(text.encode()).hexdigest()})

    at = 0
    while at < len(units):
        head = units[at]
        if head.tokens > LIMIT:
            step = TARGET if _CJK.search(head.text) else 4 * TARGET
            for i in range(0, len(head.text), step):
                add(head.section, head.page, head.page, head.text[i : i + step])
            at += 2 if skip_after_oversized else 1
            continue
        end, total = at, 0
        while end < len(units) and units[end].section == head.section and (end == at or total + units[end].tokens <= TARGET):
            total += units[end].tokens
            end += 1
        taken = units[at:end]
        add(head.section, min(u.page for u in taken), taken[-1].page, " ".join(u.text for u in taken))
        ended = end == len(units) or units[end].section != head.section
        if ended and not suffix_chunks:
            at = end
            continue
        back, carried = end, 0
        while back > at + 1 and carried < OVERLAP:
            back -= 1
            carried += units[back].tokens
        at = max(back, at + 1)
    return out


CHUNK = "paper_id long, chunk_no long, section string, page_start long, page_end long, text string, token_count long, content_hash string"


def chunk_documents(pages: DataFrame, **options) -> DataFrame:
    """Chunks of documents given as pages (paper_id, page_number, text). A document is one group; documents are independent."""
    whole = pages.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["section", "page_start", "page_end", "text", "token_count", "content_hash"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [(p, n, c) for p, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for n, c in enumerate(chunks_of([(x["page_number"], x["text"] or "") for x in doc], **options))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())] + [pa.array([r[2][n] for r in rows], k) for n, k in zip(names, kinds)], names=["paper_id", "chunk_no", *names])

    return whole.select(F.col("paper_id").cast("long"), "pages").mapInArrow(run, CHUNK)


# Abbreviations that a full stop follows inside a sentence.
ABBREVIATIONS = frozenset("e.g i.e cf vs etc al fig eq no pp p vol dr mr mrs ms prof st ch sec ref eds ed".split())
_END_MARK = re.compile("[.!?。！？][\"')\\]”’]?")


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Character ranges of a paragraph's sentences: not cut inside decimals, after section numbers and abbreviations, or
    before a lower-case letter."""
    out, start = [], 0
    for m in _END_MARK.finditer(text):
        mark, end = m.start(), m.end()
        after = text[end : end + 1]
        seen = text[end + 1 : end + 2] if after.isspace() else after
        before = text[start : mark + 1]
        word = re.search(r"[A-Za-z.]+$", before)
        inside = (
            (text[mark - 1 : mark].isdigit() and after.isdigit())
            or re.fullmatch(r"\d+(\.\d+)*\.?", before.strip())
            or (word and word[0].replace(".", "").lower() in ABBREVIATIONS)
            or "a" <= seen <= "z"
        )
        if not inside and (not after or after.isspace()):
            out.append((start, end))
            start = end
    return out + [(start, len(text))] * (start < len(text))


#: Texts whose sentences a Python worker holds at a time.
SENTENCE_ROWS = 64


def sentence_table(docs: DataFrame, id_col: str = "paper_id", text_col: str = "text") -> DataFrame:
    """Rows (id, order_index, start, end, text) of a text's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, SENTENCE_ROWS):
                part = batch.slice(at, SENTENCE_ROWS)
                rows = [(i, n, a, b, t[a:b].strip()) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for n, (a, b) in enumerate(sentence_ranges(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "order_index", "start", "end", "text"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, order_index long, start long, end long, text string")

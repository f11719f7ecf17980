"""Scalar functions over text as Column builders: all stay inside code generation or Spark's built-in lambdas."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def _fold_map() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without marks, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1:
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _fold_map()


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only, as keys compared without case are folded."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks, whether one sign holds both or the mark follows; letters of other alphabets keep theirs
    where one sign holds both, as the keyword index that results are held against has it."""
    marked = F.translate(F.regexp_replace(c, "[\\u0300-\\u036F]", ""), ACCENTED + "ſς", PLAIN + "sσ")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(marked)  # as many bytes as letters: nothing to strip


def collapse(c: Column) -> Column:
    """Runs of white space become one space, outer ones go."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_tag(c: Column) -> Column:
    return collapse(F.lower(c))


def normalize_title(c: Column) -> Column:
    """Lower case; all but letters and digits become single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def aggressive_key(c: Column) -> Column:
    """Letters and digits in lower case, without one trailing plural s of an ASCII word of more than three bytes."""
    key = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    plural = key.rlike(r"^[\x00-\x7F]{3,}s$") & ~key.endswith("ss")
    return F.when(plural, F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def sentence_id(paper: Column, page: Column, order: Column, text: Column) -> Column:
    """Deterministic id: s and 32 hexadecimal digits of the hash of place and text."""
    joined = F.concat_ws("|", paper.cast("string"), page.cast("string"), order.cast("string"), text)
    return F.concat(F.lit("s"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 32))


def estimate_tokens(c: Column) -> Column:
    """A token per CJK character and one per four of the others, rounded up."""
    other = F.length(F.regexp_replace(c, CJK, ""))
    return (F.length(c) - other + F.ceil(other / 4)).cast("long")


# Section names that end a section of a paper.
HEADINGS = [
    "abstract", "introduction", "related work", "background", "method", "methods", "methodology", "approach", "experiments",
    "experimental setup", "results", "evaluation", "discussion", "conclusion", "conclusions", "limitations", "references", "appendix",
]
MAX_HEADING_BYTES, MAX_HEADING_WORDS = 80, 6


def heading(line: Column) -> Column:
    """The trimmed line if it is a section heading, else null."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    named = F.trim(F.regexp_replace(F.lower(bare), r"^[0-9. ]+", "")).isin(HEADINGS)
    numbered = bare.rlike("^[0-9]") & bare.contains(" ") & (F.size(F.split(bare, r"(?U)\s+")) <= MAX_HEADING_WORDS)
    return F.when((bare != "") & (F.octet_length(bare) <= MAX_HEADING_BYTES) & (named | numbered), bare)


def split_oversized(c: Column, target_tokens: int = 420) -> Column:
    """Pieces of a text of so many tokens by estimate: characters if it has CJK ones, else four times as many."""
    size = F.when(c.rlike(CJK), target_tokens).otherwise(4 * target_tokens)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size)), lambda i: F.substring(c, (i * size + 1).cast("int"), size))).otherwise(F.array().cast("array<string>"))


def title_from_file_name(path: Column, fallback: str = "Untitled") -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    bare = collapse(F.translate(F.regexp_replace(name, r"\.(pdf|PDF)$", ""), "_+", "  "))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback))


# Names that an authoring tool leaves as a document's title.
TITLE_JUNK = [r"(?i)^untitled", r"(?i)^microsoft (word|powerpoint)", r"(?i)\.(pdf|docx?|dvi|tex|pptx?|indd|qxd)$", r"(?i)^(doi|https?)[:/]", r"(?i)^arxiv[:.]"]


def sanitize_title(c: Column) -> Column:
    """A cleaned title of 6 to 300 UTF-16 units and at least 4 letters that isn't junk, else null."""
    bare = collapse(c)
    units = F.length(bare) + F.length(F.regexp_replace(bare, r"[\x{0}-\x{FFFF}]", ""))
    ok = units.between(6, 300) & (F.regexp_count(bare, F.lit(r"\p{L}")) >= 4)
    for pattern in TITLE_JUNK:
        ok = ok & ~bare.rlike(pattern)
    return F.when(ok, bare)


def safe_file_name(c: Column, fallback: str = "untitled", size: int = 80) -> Column:
    """A title as a file name: separators and control characters become hyphens, dots never climb, at most 80 characters."""
    cleaned = F.regexp_replace(c, r"[/\\:*?\"<>|\p{Cc}]", "-")
    # Each pass turns pairs of dots into hyphens; what is left has no two dots in a row.
    flat = F.regexp_replace(cleaned, r"\.\.", "-")
    bare = F.regexp_replace(F.regexp_replace(F.trim(flat), r"^[.\- ]+|[.\- ]+$", ""), r"(?U)^\s+|\s+$", "")
    cut = F.trim(F.substring(bare, 1, size))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def sanitize_link(c: Column) -> Column:
    return collapse(F.translate(c, "[]|#^", "     "))


def percent_encode(c: Column) -> Column:
    """Percent-encoding of all but ASCII letters and digits."""
    encoded = F.url_encode(c)
    for plain, code in (("\\+", "%20"), ("-", "%2D"), ("_", "%5F"), ("\\.", "%2E"), ("\\*", "%2A")):
        encoded = F.regexp_replace(encoded, plain, code)
    return encoded


def needs_translation(c: Column, target: Column) -> Column:
    """Whether a text of at least 20 letters has little of the target language's script."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    hangul = F.regexp_count(c, F.lit(r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]")) / letters
    latin = F.regexp_count(c, F.lit(r"[A-Za-z]")) / letters
    few = F.when(target == "ko", hangul < 0.3).when(target == "en", latin < 0.3).otherwise((hangul < 0.3) & (latin < 0.3))
    return F.when(letters < 20, F.lit(False)).otherwise(few)


def parse_citations(c: Column, count: Column) -> Column:
    """Numbers of markers [S3] or [s3] from 1 to count, in first-seen order, each once."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[[sS](\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= count)))


def allowed(values: Column, context: Column) -> Column:
    """Values that the context holds, in their order."""
    return F.filter(values, lambda x: F.array_contains(context, x))


def normalize_running(c: Column) -> Column:
    """A header or footer line with its digits masked."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"[0-9]+", "#"))


def ends_sentence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "").rlike(r"""[.!?。！？…]["')\]”’]*$""")


def strip_code_fence(c: Column) -> Column:
    """JSON out of a fenced block."""
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?U)^```(json)?\s*", ""), r"(?U)\s*```$", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def backoff_seconds(attempts: Column, most: int = 300) -> Column:
    exponent = F.least(F.lit(6), F.greatest(F.lit(1), attempts))
    return F.least(F.lit(most).cast("long"), F.pow(F.lit(2), exponent).cast("long"))


def plus_seconds(time: Column, seconds: Column) -> Column:
    """A time some seconds later, or earlier where there are less than none."""
    return F.timestamp_micros(F.unix_micros(time) + seconds.cast("long") * 1_000_000)


def iso8601(time: Column) -> Column:
    """A time in UTC as ISO 8601 with milliseconds; the session's time zone is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def idempotency_key(paper: Column, kind: Column, version: Column) -> Column:
    return F.concat_ws(":", paper.cast("string"), kind, version)


def lineage(year: Column, centre_year: Column) -> Column:
    return F.when(year < centre_year, "precedent").when(year > centre_year, "derivative").otherwise("concurrent")


def next_offset(offset: Column, limit: Column, total: Column, ceiling: int = 1000) -> Column:
    return F.when(offset + limit < F.least(total, F.lit(ceiling)), offset + limit)


def source_id_ok(c: Column, prefix: str) -> Column:
    return c.rlike(f"^{prefix}:[A-Za-z0-9]+$")


def hashtag(c: Column) -> Column:
    return F.concat(F.lit("#"), F.regexp_replace(c, " ", "-"))


def page_links(pages: Column, suffix: str = "p") -> Column:
    """Pages in brackets after a claim; nothing if there are none."""
    joined = F.array_join(F.transform(pages, lambda p: F.concat(p.cast("string"), F.lit(suffix))), ", ")
    return F.when(F.size(pages) > 0, F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise(F.lit(""))


def language_name(code: Column, names: dict[str, str] | None = None) -> Column:
    names = names or {"ko": "Korean", "en": "English", "ja": "Japanese", "zh": "Chinese"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def zoom_to_slider(zoom: Column, low: float = 0.1, high: float = 4.0) -> Column:
    return F.log(zoom / low) / F.log(F.lit(high / low))


def slider_to_zoom(slider: Column, low: float = 0.1, high: float = 4.0) -> Column:
    return F.lit(low) * F.pow(F.lit(high / low), slider)


def tag_is_reasonable(c: Column, max_chars: int = 36, max_words: int = 4) -> Column:
    bare = collapse(c)
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return (bare != "") & (F.length(trimmed) <= max_chars) & (F.size(F.split(bare, " ")) <= max_words)


# -- rectangles on a page, as structs (x, y, width, height) of fractions ------------------------------------------------


def rect_valid(r: Column, slack: float = 1.0001) -> Column:
    inside = r["x"].between(0, 1) & r["y"].between(0, 1)
    return inside & (r["width"] > 0) & (r["height"] > 0) & (r["x"] + r["width"] <= slack) & (r["y"] + r["height"] <= slack)


def rect_clamp(r: Column) -> Column:
    x, y = F.least(F.greatest(r["x"], F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(r["y"], F.lit(0.0)), F.lit(1.0))
    width, height = F.greatest(F.lit(0.0), F.least(r["width"], 1.0 - x)), F.greatest(F.lit(0.0), F.least(r["height"], 1.0 - y))
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def usable_rects(rects: Column) -> Column:
    """Rectangles clamped to the page, without those that nothing is left of."""
    return F.filter(F.transform(rects, rect_clamp), lambda r: rect_valid(r))

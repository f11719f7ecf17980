"""Main text of web pages by line-block distribution.

Markup is stripped so that each block-level element leaves its text on a line of its own; what markup names as no part of
an article (menus, footers, adverts, forms, scripts, link lists) leaves blank lines.  Names that authors give decide after the text:
a first pass measures what each element so named holds, and one that wraps the page's text, its title or its main element is no
furniture, whatever its class says.  The text lengths of each window of
neighbouring lines are summed; the text begins where the sum surges and ends where it dives to nothing, and what lies
between is kept, short paragraphs included.  Surge and dive decide inside article and main elements too; what lies outside is
left out only if such an element holds enough text beside the densest run outside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkfolio.llm.shared import col

#: Elements whose content is never text of the page.
UNSEEN = ("script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "canvas", "audio", "video", "select", "textarea")
#: Elements that hold navigation, page furniture and forms.
FURNITURE = frozenset("nav footer aside menu dialog header".split())
#: Elements of forms; one of them in an element says that it is to be filled in.
CONTROLS = frozenset("button select textarea input".split())
#: Elements that don't end a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input button select textarea svg math mi mn mo ms mtext mrow mfrac msub msup msubsup msqrt mroot mover munder munderover mstyle semantics annotation".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block ends if they are open.
ENDED_BY_BLOCK = frozenset("p".split())
#: Words of class, id and role that name what is no part of an article; "has-", "with-" and "no-" before them say nothing.
FURNITURE_NAME = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|aside|related|recommend\w*|share|sharing|social|footer|pagination|pager|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
#: Words that name what readers wrote.
COMMENT_NAME = re.compile(r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:comments?|commentlist|respond|replies|disqus)(?=$|[\s_-])", re.I)
#: Words that an article's own parts bear as well, about the matter itself; inside an article they say something of links and controls only.
MATTER_NAME = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|share|sharing|social)(?=$|[\s_-])", re.I)
#: Words that do so where no other word names the article's own parts ("post-header").
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:banner|notice|notification|alert|popup|modal|overlay|login|side|widget\w*|header|masthead|toolbar|search|dialog)(?=$|[\s_-])", re.I)
OWN_NAME = re.compile(r"(?:^|[\s_-])(?:content|main|article|post|entry|story|title|body)(?=$|[\s_-])", re.I)
#: Names that as the whole id of a box say the same inside an article.
FURNITURE_ID = frozenset("comments disqus_thread respond sidebar related-posts share-buttons newsletter".split())
#: Elements whose class or role may name them furniture inside an article; headings and inline elements are its own there.
BOXES = frozenset("div section p ul ol dl table span figure center article".split())
#: A comment, a declaration or a tag.  Quantifiers never give back, and what is cut off runs to the end of the page, so that
#: no part of a page is read twice.  A quotation mark counts after an equals sign only, and only if it is closed.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s]*+)))?")
SPACE = re.compile(r"\s+")
#: What ends a sentence at a line's end.
ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")
#: Elements without text of the page that run to the page's end if they are left open.
RAW = frozenset("script style noscript iframe".split())


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts, one without a value is empty."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


#: What an element is by its name and those that its author gave it: none, or no part of an article in any case; the others are
#: judged by what they hold.
NONE, ALWAYS, LAYOUT, COMMENTS, FORM, MATTER = range(6)


def _furniture(name: str, raw: str, inside_article: bool) -> int:
    """What kind of furniture an element may be."""
    if name in FURNITURE and not (name == "header" and inside_article):
        return ALWAYS
    plain = FORM if name == "form" else NONE
    if not raw.strip(" \t\n\r\f/"):
        return plain
    given = attributes_of(raw)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return NONE if name in ("html", "body", "main") else ALWAYS
    if name in ("html", "body", "main"):
        return NONE
    if inside_article and name in BOXES and (known := given.get("id", "").lower()) in FURNITURE_ID:
        return COMMENTS if known in ("comments", "disqus_thread", "respond") else LAYOUT
    if inside_article and name not in BOXES:
        return plain
    for v in [given.get(k, "") for k in (("class", "role") if inside_article else ("class", "role", "id"))]:
        if COMMENT_NAME.search(v) and (name != "article" or "comment" in v.lower()):
            return COMMENTS
        if name == "article":
            continue
        if inside_article and MATTER_NAME.search(v) and not FURNITURE_NAME.search(MATTER_NAME.sub(" ", v)):
            return MATTER
        if FURNITURE_NAME.search(v) or (WEAK_NAME.search(v) and not OWN_NAME.search(v)):
            return LAYOUT
    return plain


class Survey:
    """What the elements that may be furniture hold, in the order of their start tags: characters, those inside links, controls, main
    elements and headings of the first degree, articles, sentences."""

    def __init__(self) -> None:
        self.kinds: list[int] = []
        self.held: list[tuple[int, ...]] = []
        self.now = [0, 0, 0, 0, 0, 0]

    def open(self, kind: int) -> int:
        self.kinds.append(kind)
        self.held.append(tuple(self.now))
        return len(self.kinds) - 1

    def close(self, number: int) -> None:
        self.held[number] = tuple(a - b for a, b in zip(self.now, self.held[number]))

    def spared(self) -> frozenset[int]:
        """Elements that are no furniture: wrappers of most of the page's text, as long as what marks an article doesn't stand
        outside them, and what speaks of shares or relations without links."""
        everything, marks = self.now[0] - self.now[1], self.now[3] + self.now[4]
        out = set()
        for number, (kind, (size, linked, controls, heads, articles, sentences)) in enumerate(zip(self.kinds, self.held)):
            text = size - linked
            wraps = 2 * text > everything and (heads + articles > 0 or not marks)
            if kind == COMMENTS:
                wraps = 10 * text > 9 * everything and (heads > 0 or not marks)
            elif kind == MATTER:
                wraps |= sentences > 0 and 2 * linked <= size and not controls
            if wraps:
                out.add(number)
        return frozenset(out)


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """Lines of a page in order: text (blank for furniture), characters of it inside links, number of the outermost article or
    main element around it (0 outside).  The time grows with the page's length, however its tags are nested or left open."""
    survey = Survey()
    lines = _read(html, survey, None)
    return _read(html, Survey(), survey.spared()) if survey.kinds else lines


def _read(html: str, survey: Survey, spared: frozenset[int] | None) -> list[tuple[str, int, int]]:
    """Lines of a page. spared: elements that are no furniture, by number; None: none but those that always are."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = buttons = 0
    stack: list[tuple[str, bool, bool, int]] = []  # name, starts furniture, is article, number in the survey
    blocks: list[int] = []  # places in the stack of elements that end a line
    opened: Counter[str] = Counter()
    furniture = article = links = pressed = matter = element = block = blank = 0
    never_closed: set[str] = set()
    at = 0

    def close_line() -> None:
        nonlocal linked, buttons, blank
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        if text and buttons and buttons >= sum(len(p.strip()) for p in parts):
            text = ""  # nothing but buttons
        # Each block of furniture leaves a blank line, so that a menu makes a wide gap and an advert a narrow one; inside an
        # article, which a short line ends as often as not, an element of furniture leaves one.
        if text or (furniture and not (article and blank == block)):
            blank = 0 if text else block
            out.append((text, linked, element if article else 0))
        parts.clear()
        linked = buttons = 0

    def pop() -> str:
        nonlocal furniture, article, links, pressed, matter
        name, starts, is_article, number = stack.pop()
        if number >= 0:
            survey.close(number)
            matter -= survey.kinds[number] == MATTER
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        opened[name] -= 1
        furniture -= starts
        article -= is_article
        links -= name == "a"
        pressed -= name == "button"
        return name

    while at < len(html):
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece and not furniture:
            parts.append(piece)
            size = len(piece.strip())
            linked += size * (links > 0)
            buttons += size * (pressed > 0)
            survey.now[0] += size
            survey.now[1] += size * (links > 0 or pressed > 0)
            if matter and len(piece.split(None, 3)) > 2:
                survey.now[5] += ENDS.search(piece.rstrip()[-8:]) is not None
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        closing, name, raw = bool(m[1]), m[2].lower(), m[3] or ""
        if name not in INLINE:
            close_line()
        elif name == "br" and not furniture:
            parts.append(" ")
        elif name in ("svg", "select") and not furniture:
            parts.append(" ")
        if not closing and not furniture:
            survey.now[2] += name in CONTROLS and "hidden" not in raw.lower()
            survey.now[3] += name in ("h1", "main")
            survey.now[4] += name == "article"
        if closing:
            while opened[name] and pop() != name:
                pass
            continue
        if name in UNSEEN and not raw.rstrip().endswith("/"):
            if name not in never_closed:
                end = re.compile(rf"</{name}\s*+>", re.I).search(html, at)
                if end or name in RAW:
                    at = end.end() if end else len(html)
                else:
                    never_closed.add(name)
            continue
        if name in VOID or raw.rstrip().endswith("/"):
            continue
        if name not in INLINE:
            # A block ends an open paragraph, and with it the inline elements that were left open in it.
            if blocks and stack[blocks[-1]][0] in ENDED_BY_BLOCK:
                place = blocks[-1]
                while len(stack) > place:
                    pop()
            blocks.append(len(stack))
        kind = _furniture(name, raw, article > 0)
        number = survey.open(kind) if kind > ALWAYS else -1
        matter += kind == MATTER
        starts = kind == ALWAYS or (number >= 0 and spared is not None and number not in spared)
        is_article = name in ("article", "main")
        stack.append((name, starts, is_article, number))
        opened[name] += 1
        block += starts and not furniture
        furniture += starts
        element += is_article and not article
        article += is_article
        links += name == "a"
        pressed += name == "button"
    close_line()
    while stack:
        pop()
    return out


def _runs(length: list[int], window: int) -> list[tuple[int, int, int, int]]:
    """Runs of windows that hold text, from where the sum leaves nothing to where it dives to nothing again: start, end, highest
    sum, characters."""
    n = len(length)
    sums = [sum(length[i : i + window]) for i in range(n)]
    runs, start = [], -1
    for i in range(n + 1):
        if i < n and sums[i]:
            start = i if start < 0 else start
        elif start >= 0:
            runs.append((start, i, max(sums[start:i]), sum(length[start:i])))
            start = -1
    return runs


def main_text(html: str | None, window: int = 3, surge: int = 60, link_share: float = 0.5) -> str:
    """The text between surge and dive points. window: lines of a sum; surge: characters in a window that begin a text.

    An article or main element names the text unless the densest run outside has both a higher sum than it and more than twice
    its characters; if no element does, as where the elements are teasers beside a story, the runs outside are the text.
    """
    lines = lines_of(html or "")
    links = [k > link_share * len(t) for t, k, _ in lines]
    length = [0 if link else len(t) for (t, _, _), link in zip(lines, links)]
    outside = _runs([0 if e else size for (_, _, e), size in zip(lines, length)], window)
    inside = _runs([size if e else 0 for (_, _, e), size in zip(lines, length)], window)
    if inside and outside:
        densest = max(outside, key=lambda r: r[2])
        elements = [_runs([length[i] for i in at], window) for e, at in groupby(range(len(lines)), key=lambda i: lines[i][2]) if e]
        marked = any(max(r[2] for r in e) >= densest[2] or 2 * sum(r[3] for r in e) >= densest[3] for e in elements if e)
    else:
        marked = bool(inside)
    runs = inside if marked else outside
    least = min(max((r[2] for r in runs), default=0), surge)
    kept = []
    for a, b, peak, _ in runs:
        if peak < least and not (marked and any(ENDS.search(lines[i][0]) for i in range(a, b))):
            continue  # inside an article a short sentence between pieces of furniture is text like any other
        begun = False
        for i in range(a, b):
            text, _, element = lines[i]
            if not text or bool(element) != marked:
                continue
            # Inside, a link on a line of its own stays between lines of text, or alone before them, as a linked title does; elsewhere
            # a single one between two lines of text.
            if not links[i] or (marked and (begun or not (i and links[i - 1]) and not links[i + 1])) or (begun and length[i - 1] and i + 1 < b and length[i + 1]):
                kept.append(text)
            begun = begun or not links[i]
    return "\n".join(kept)


#: Pages that are read at once.
ROWS = 128


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars).

    Each page is read alone, whole, without a shuffle.  A null or empty page gives an empty text and 0 characters; a page cut
    off inside a tag, a comment or a script is read up to there; null ids and urls are kept; repeated rows are read each; an
    empty table gives an empty table; further columns of ``df`` are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([df.schema[id_col], df.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).alias("html")).mapInArrow(extract, schema)

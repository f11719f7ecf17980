import base64
import gzip
import hashlib
import html
import io
import re
import struct
import time
import zipfile

import pytest

from sparkfolio.llm import archive
from sparkfolio.llm.html_blocks import extract_pages, main_text


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("<p>cut off <b", "cut off"),
        ("<article><h1>T</h1><p>One&nbsp; two\n three<br>four<p>Five</article><footer>F</footer>", "T\nOne two three four\nFive"),
        ("<article><p>Keep.</p><div class='ad'>Buy</div><aside>Side</aside><form><p>Name</p></form><p>Also.</p><script>var t='</p>';</script></article>", "Keep.\nAlso."),
        ("<body><!-- <p>no</p> --><nav><p>" + "menu " * 30 + "</p></nav><main><p>Short.</p></main></body>", "Short."),
        ("<div class='content has-sidebar'><div class='entry-header'><h1>Title of it all</h1></div><div role=alert>Warning!</div><p>" + "Words. " * 20 + "</p></div><div id='comments'><p>" + "said " * 40 + "</p></div>", "Title of it all\n" + ("Words. " * 20).strip()),
        ("<article><p>Text.</p></article><div id='comments'><article class='comment'><p>" + "said " * 40 + "</p></article></div>", "Text."),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_text_between_surge_and_dive():
    body = "".join(f"<p>{'A paragraph of the article. ' * 4}</p><p>Short one.</p>" for _ in range(5))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<html><body><div class=top-menu>{menu}</div><div>{body}</div><div class=sidebar>{menu}</div><div class='cookie-notice'>We use cookies</div></body></html>"
    assert main_text(page).split("\n") == [x for _ in range(5) for x in (("A paragraph of the article. " * 4).strip(), "Short one.")]


STORY = [f"Paragraph {i} of the story, which goes on for a while and says what happened next to all of them." for i in range(6)]
STORY_HTML = "".join(f"<p>{x}</p>" for x in STORY)
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Another page {i}</a></li>" for i in range(8)) + "</ul>"


def test_surge_and_dive_decide_inside_marked_elements():
    assert main_text(f"<main><p>Edition 7</p>{LINKS}{STORY_HTML}{LINKS}<p>Print</p></main>").split("\n") == STORY
    assert main_text(f"<article>{STORY_HTML}<div class=ad>{LINKS}</div><p>The end.</p></article>").split("\n") == [*STORY, "The end."]
    linked = f"<article><h1><a href='/1'>A linked title</a></h1>{STORY_HTML}<p><a href='/2'>A linked line between</a></p><p>The end.</p></article>"
    assert main_text(linked).split("\n") == ["A linked title", *STORY, "A linked line between", "The end."]


def test_unmarked_page_keeps_linked_and_short_lines_of_its_text():
    text = f"<div>{STORY_HTML}<p><a href='/2'>A study that the story links to</a></p>{STORY_HTML}<p>The end.</p><div class=ad>Buy</div><p>Printed in May.</p></div>"
    assert main_text(f"<body><div class=top>{LINKS}</div>{text}<div>{LINKS}</div></body>").split("\n") == [*STORY, "A study that the story links to", *STORY, "The end.", "Printed in May."]


def test_story_beside_marked_teasers():
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>A card that says in a few words what page {i} holds for its readers.</p></article>" for i in range(20))
    for page in (f"<body><div>{STORY_HTML}</div>{teasers}</body>", f"<body>{teasers}<div>{STORY_HTML}</div></body>"):
        assert main_text(page).split("\n") == STORY
    assert main_text(f"<body>{teasers}</body>").count("Teaser") == 20
    assert main_text(f"<article>{STORY_HTML}</article><div><p>{'A note below the story. ' * 8}</p></div>").split("\n") == STORY


@pytest.mark.parametrize(
    "start,end",
    [
        ("<p title='a hidden gem'>", "</p>"),
        ("<div data-hidden='false'>", "</div>"),
        ("<p data-id='share'>", "</p>"),
        ("<section id='social'>", "</section>"),
        ("<h2 id='related-work'>", "</h2>"),
        ("<h2 id='comments'>", "</h2>"),
        ("<p don't>", "</p>"),
        ("<p data-x='a>b'>", "</p>"),
    ],
)
def test_attributes_are_parsed(start, end):
    assert main_text(f"<article><p>First.</p>{start}Kept words.{end}<p>Last.</p></article>") == "First.\nKept words.\nLast."


@pytest.mark.parametrize("start", ["<div class='share'>", "<div id=comments>", "<div hidden>", "<p style='display: none'>", "<ul role=navigation>", "<div aria-hidden=true>"])
def test_named_furniture_goes(start):
    assert main_text(f"<article><p>First.</p>{start}Gone.</{start[1:].split()[0]}><p>Last.</p></article>") == "First.\nLast."


WRAPPED = [
    ("<form id='aspnetForm'><div>{}</div></form>", ""),
    ("<div class='container sidebar-right'>{}</div>", ""),
    ("<div class='page with-sidebar-left menu-open'>{}</div>", ""),
    ("<div class='comments-open'>{}</div>", ""),
    ("<article>{}<p class='social'>Social policy changed.</p></article>", "Social policy changed."),
    ("<article>{}<section class='related'><h2>Related work</h2><p>Others did it.</p></section></article>", "Related work\nOthers did it."),
    ("<article>{}<div class='share'>Share prices rose.</div></article>", "Share prices rose."),
    ("<article>{}<div class='share'>Share this page: <a>here</a> <a>and there</a>.</div></article>", ""),
    ("<article>{}<aside>x</aside><aside>x</aside><aside>x</aside><aside>x</aside><p>The end.</p></article>", "The end."),
    ("<article>{}<p>Press <button>OK</button> to go</p></article>", "Press OK to go"),
    ("<article>{}<button>Share</button><p>More.</p></article>", "More."),
    ("<article>{}<p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
    ("<article>{}<section id='comments'>First! A nice post.</section></article>", ""),
    ("<article>{}<ol id='comments'><li>First!</li></ol></article>", ""),
    ("<div>{}</div><form><p>Sign up</p><input name=q><button>Go</button></form>", ""),
    ("<div class='sidebar'><p>About us.</p></div><div>{}</div><div class='comments'><p>Nice.</p></div>", ""),
    ("<article><p>Brief.</p></article><div class='sidebar'>{}</div>", None),
]


@pytest.mark.parametrize("page,end", WRAPPED)
def test_text_decides_before_names(page, end):
    """Wrappers of the page's text are no furniture, whatever they are called; small boxes are."""
    want = ["Brief."] if end is None else STORY + [x for x in end.split("\n") if x]
    assert main_text(page.format(STORY_HTML)).split("\n") == want


def test_pages_without_names_give_the_same(spark, sf_dir):
    """Line blocks alone find the same text: a plain version over all pages whose elements' names and classes are taken away."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|form|section)\b[^>]*>", r"<\1div>", re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html))
        assert set(main_text(r.html).split("\n")) <= set(main_text(bare).split("\n"))


@pytest.mark.parametrize(
    "part,end",
    [("<a ", '"'), ('<a ="', ""), ("<div>", "</b>"), ("<title>", ""), ("<b>", "<div></div>" * 100_000), ("<p><td>", "<b>" * 100_000 + "<div></div>" * 100_000), ("<!--", ""), ("<a href='x", ""), ("<svg>", ""), ("<", ""), ("</i>", ""), ("<nav><b></nav>", "")],
)
def test_time_grows_with_the_page(part, end):
    """Pages of about a megabyte whose tags are left open, nested deeply or never opened."""
    begin = time.process_time()
    main_text("<p>Text.</p>" + part * (1_000_000 // len(part)) + end)
    assert time.process_time() - begin < 10


def test_very_long_page():
    paragraphs = [f"Paragraph {i} of a very long page, which has many of them." for i in range(40_000)]
    assert main_text("<article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article>") == "\n".join(paragraphs)


def test_pages_query_equals_articles(spark, sf_dir):
    from sparkfolio.llm.queries import op6_html_text

    got = {r.page_id: (r.text, r.n_chars) for r in op6_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_page_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract_pages(df).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert extract_pages(df.limit(0)).count() == 0
    clash = df.selectExpr("page_id", "url", "html", "'old' as text", "1 as n_chars")
    assert extract_pages(clash).columns == ["page_id", "url", "text", "n_chars"] and extract_pages(clash).where("text = 'old'").count() == 0


# -- archives ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("comment", [b"", b"PK\5\6 in a comment"])
def test_stored_members_are_found(comment):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("stored"), "w", force_zip64=True) as f:
            f.write(b"payload")
        z.comment = comment
    data = raw.getvalue()
    found = archive.members(lambda at, n: data[at : at + n], len(data))
    assert set(found) == {"stored"}
    at, n = found["stored"]
    assert data[at : at + n] == b"payload"


def test_zip64_directory():
    """An archive whose end record and directory entry leave all to ZIP64 fields."""
    name, body = b"archive/x", b"hello"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + entry + end64 + locator + end
    assert archive.members(lambda a, n: data[a : a + n], len(data)) == {"archive/x": (30 + len(name), len(body))}


def test_damage_is_seen():
    with pytest.raises(ValueError):
        archive.members(lambda a, n: b"no zip here"[a : a + n], 11)
    record = archive.record("<urn:page:1>", "u", b"<p>", None)
    assert archive.parse_record(record)["payload"] == b"<p>"
    for damaged in (record.replace(b"<p>", b"<q>"), record[:-6]):
        with pytest.raises(ValueError):
            archive.parse_record(damaged)


def brute_records(rows):
    largest = {}
    for i, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw, top = (h or "").encode(), largest.get(h or "")
        again = top is not None and top != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(0, "<p>a</p>"), (1, "x"), (2, None), (3, ""), (4, "x"), (5, "é\r\n\r\n"), (6, "x"), (None, "x"), (None, "zz"), (4, "x")]
    df = spark.createDataFrame([(i, f"u{i}\r\n", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    out = archive.round_trip(df, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute_records(rows)
    assert {bytes(r.payload).decode() for r in out if r.record_type == "response"} == {"<p>a</p>", "x", "", "é\r\n\r\n", "zz"}
    assert archive.round_trip(df.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in archive.round_trip(df, min_bytes=100).collect())


def test_ids_of_any_type_and_further_columns(spark):
    rows = [("a/b >", "x"), ("", "x"), ("null", "y"), (None, "y"), ("é", "z" * 3_000_000)]
    df = spark.createDataFrame([(i, h, f"u{i}", 1, b"d", "r") for i, h in rows], "name string, html string, link string, id int, digest binary, rep string")
    out = archive.round_trip(df, id_col="name", url_col="link").collect()
    assert {(r.name, r.record_type, r.refers_to, r.payload_bytes) for r in out} == {("a/b >", "response", None, 1), ("", "revisit", "a/b >", 1), ("null", "response", None, 1), (None, "revisit", "null", 1), ("é", "response", None, 3_000_000)}


def foreign_record(kind, name, block, **more):
    head = {"warc-type": kind, "WARC-RECORD-ID": name, "WARC-Date": "2020-01-01T00:00:00Z", "content-LENGTH": len(block)} | more
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.0 200 OK\r\ncontent-type: text/html\r\n"
FOREIGN = [
    foreign_record("warcinfo", "<urn:uuid:0>", b"software: none\r\n"),
    foreign_record("response", "<urn:uuid:1>", HTTP + b"\r\nfirst", **{"WARC-Target-URI": "http://a/1"}),
    foreign_record("request", "<urn:uuid:2>", b"GET / HTTP/1.0\r\n\r\n", **{"Content-Type": "application/http; msgtype=request"}),
    foreign_record("response", "<urn:uuid:3>", HTTP + b"Content-Length: 6\r\n\r\nsecond", **{"WARC-Payload-Digest": "SHA1:" + archive.payload_digest(b"second").lower(), "X-Long": "a\r\n b"}),
    foreign_record("revisit", "<urn:uuid:4>", HTTP + b"\r\n", **{"WARC-Refers-To": "<urn:uuid:1>", "WARC-Payload-Digest": "md5:0"}),
    foreign_record("resource", "<urn:uuid:5>", b"\x00\r\n\r\nbytes"),
]


def foreign_archive(path, packed_records, index, packed_index):
    """A package of two WARC members, as others write them: index lines (key, time, JSON with text offsets) of the second's records."""
    places = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        for i, part in enumerate((FOREIGN[:3], FOREIGN[3:])):
            name = f"rec-{i}.warc" + ".gz" * packed_records
            body, at = b"", 0
            for record in part:
                body += (one := gzip.compress(record) if packed_records else record)
                places.append(f'a,{i})/ 2020010100 {{"url": "http://a", "filename": "{name}", "offset": "{at}", "length": {len(one)}}}\n')
                at += len(one)
            z.writestr(f"archive/{name}", body)
        if index:
            body = "!meta 0 {}\n" + "".join(places)
            z.writestr("indexes/index.cdx.gz" if packed_index else "indexes/index.cdxj", gzip.compress(body.encode()) if packed_index else body, zipfile.ZIP_STORED if packed_index else zipfile.ZIP_DEFLATED)


@pytest.mark.parametrize("packed_records,index,packed_index", [(True, True, False), (True, True, True), (False, True, False), (True, False, False), (False, False, False)])
def test_archives_of_others(spark, tmp_path, packed_records, index, packed_index):
    paths = [str(tmp_path / f"{i}.wacz") for i in range(2)]
    for p in paths:
        foreign_archive(p, packed_records, index, packed_index)
    out = archive.read_archives(spark.createDataFrame([(p,) for p in paths], "path string"), payloads=True).collect()
    got = sorted((r.record_id, r.record_type, r.url, r.payload_bytes, r.refers_to, r.payload and bytes(r.payload)) for r in out)
    want = [
        ("<urn:uuid:0>", "warcinfo", "", 16, None, b"software: none\r\n"),
        ("<urn:uuid:1>", "response", "http://a/1", 5, None, b"first"),
        ("<urn:uuid:2>", "request", "", 0, None, b""),
        ("<urn:uuid:3>", "response", "", 6, None, b"second"),
        ("<urn:uuid:4>", "revisit", "", None, "<urn:uuid:1>", None),
        ("<urn:uuid:5>", "resource", "", 10, None, b"\x00\r\n\r\nbytes"),
    ]
    assert got == sorted(want * 2)
    assert {r.payload_digest for r in out if r.record_id == "<urn:uuid:1>"} == {archive.payload_digest(b"first")}


def test_ranges_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(archive, "RANGE_BYTES", 1000)
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "concat(id, repeat(md5(cast(id as string)), 20)) as html").repartition(2)
    assert archive.round_trip(df).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert archive.round_trip(df).count() == 200


def test_archive_query(spark, sf_dir):
    from sparkfolio.llm.queries import op3_warc

    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op3_warc(spark, sf_dir).collect()), key=str)
    assert got == brute_records(rows)

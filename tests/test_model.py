"""Behaviour of functions and operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import text as X
from sparkfolio.operators import analysis, documents, graphs, jobs, layout, library, notes, translation, upserts
from sparkfolio.sources import importing, records
from sparkfolio.streaming import changes


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'long' if isinstance(values[n], int) else 'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("word,key", [("Attentions", "attention"), ("attention", "attention"), ("class", "class"), ("bus", "bus"), ("Re-Ranking", "reranking"), ("주의s", "주의s")])
def test_aggressive_key(spark, word, key):
    assert one(spark, X.aggressive_key(F.col("t")), t=word) == key


def test_scalars(spark):
    assert one(spark, X.normalize_tag(F.col("t")), t="  Deep \t RAG  ") == "deep rag"
    assert one(spark, X.normalize_title(F.col("t")), t="Attention Is All You Need.") == "attention is all you need"
    assert one(spark, X.estimate_tokens(F.col("t")), t="한국어 abcd") == 3 + 2
    assert one(spark, X.parse_citations(F.col("t"), F.lit(3)), t="[S2] [s1] [S2] [S9] [S] [Sx] [12] [") == [2, 1]
    assert one(spark, X.safe_file_name(F.col("t")), t="../a/b: c?..") == "a-b- c"
    assert one(spark, X.safe_file_name(F.col("t")), t="...") == "untitled"
    assert one(spark, X.sanitize_title(F.col("t")), t="Microsoft Word - x") is None
    assert one(spark, X.sanitize_title(F.col("t")), t=" A  fine title ") == "A fine title"
    assert one(spark, X.percent_encode(F.col("t")), t="a b-c_é*") == "a%20b%2Dc%5F%C3%A9%2A"
    assert one(spark, X.strip_code_fence(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, X.heading(F.col("t")), t=" 3.1 Results ") == "3.1 Results"
    assert one(spark, X.heading(F.col("t")), t="2 things that are said here in length") is None
    assert one(spark, X.language_name(F.col("t")), t="ko") == "Korean"
    assert one(spark, X.source_id_ok(F.col("t"), "semantic-scholar"), t="semantic-scholar:ab12") is True
    assert one(spark, X.source_id_ok(F.col("t"), "semantic-scholar"), t="semantic-scholar:../x") is False
    assert [one(spark, X.backoff_seconds(F.col("n")), n=n) for n in (0, 1, 2, 3, 6, 20)] == [2, 2, 4, 8, 64, 64]
    assert one(spark, X.needs_translation(F.col("t"), F.lit("ko")), t="An English sentence of some length") is True
    assert one(spark, X.needs_translation(F.col("t"), F.lit("en")), t="An English sentence of some length") is False


def test_rectangles(spark):
    rects = "array<struct<x:double,y:double,width:double,height:double>>"
    df = spark.createDataFrame([([(0.9, 0.9, 0.5, 0.5), (0.1, 0.1, 0.0, 0.2)],)], f"rects {rects}")
    kept = df.select(X.usable_rects(F.col("rects"))).first()[0]
    assert len(kept) == 1 and abs(kept[0]["width"] - 0.1) < 1e-9
    line = spark.createDataFrame([([(0.1, 0.5, 0.8, 0.02)], (0.4, 0.5, 0.1, 0.02))], f"rects {rects}, cut struct<x:double,y:double,width:double,height:double>")
    rest = line.select(layout.subtract_rect(F.col("rects"), F.col("cut"))).first()[0]
    assert [round(r["x"], 3) for r in rest] == [0.1, 0.505]
    before, after = line.select(*layout.split_around(F.col("rects"), F.col("cut"))).first()
    assert len(before) == len(after) == 1
    merged = layout.merge_rects([dict(x=0.1, y=0.5, width=0.1, height=0.02), dict(x=0.3, y=0.501, width=0.1, height=0.02), dict(x=0.1, y=0.6, width=0.1, height=0.02)])
    assert len(merged) == 2 and abs(merged[0]["width"] - 0.3) < 1e-9
    assert layout.with_merged_rects(line.select("rects")).first()["merged"][0]["x"] == 0.1
    assert len(layout.merge_bars([dict(top=0, bottom=10, left=0, right=20), dict(top=1, bottom=11, left=25, right=40), dict(top=0, bottom=10, left=90, right=100)])) == 2


def test_chunks():
    text = "\n".join(f"Sentence number {i} says something of a certain length, as sentences do." for i in range(200))
    chunks = documents.chunks_of([(1, text)])
    assert all(c["token_count"] <= documents.LIMIT for c in chunks) and len(chunks) > 5
    assert all(c["text"].endswith(".") for c in chunks)
    parts = documents.chunks_of([(1, "Introduction\nFirst part is here now.\nConclusion\nLast part is here now.")], suffix_chunks=False)
    assert [c["section"] for c in parts] == ["Introduction", "Conclusion"]
    long = documents.chunks_of([(1, "word " * 4000), (2, "And a next sentence.")], suffix_chunks=False)
    assert max(c["token_count"] for c in long) <= documents.LIMIT and long[-1]["text"] == "And a next sentence."
    assert documents.chunks_of([(1, "  ")]) == []
    three = documents.chunks_of([(1, "One sentence is here. Two sentences are here. Three sentences are here.")])
    assert len(three) == 3  # the last ones again, ever shorter


@pytest.mark.parametrize("text,n", [("It rose to 28.4 percent. Then it fell.", 2), ("As shown in Fig. 3 it works. Yes!", 2), ("2. Method", 1), ("He said so. and went on.", 1), ("", 0)])
def test_sentences(text, n):
    assert len(documents.sentence_ranges(text)) == n


def test_tag_intersection_and_views(spark):
    tags = spark.createDataFrame([(1, "rag"), (1, "llm"), (2, "rag")], "paper_id long, tag string")
    assert [r.paper_id for r in library.has_all_tags(tags, ["RAG ", "llm"]).collect()] == [1]


def test_newer_note_wins(spark):
    keep = spark.createDataFrame([(1, "old", 1), (2, "same", 5)], "k long, v string, t long")
    other = spark.createDataFrame([(1, "new", 2), (2, "other", 5), (3, "only", 1)], "k long, v string, t long")
    assert {(r.k, r.v) for r in upserts.newest_wins(keep, other, ["k"], "t").collect()} == {(1, "new"), (2, "same"), (3, "only")}


def test_tag_fold(spark):
    notes_ = spark.createDataFrame([(1, 9, "older", 1), (2, 9, "newer", 2)], "tag_id long, paper_id long, insight string, updated_at long")
    members = spark.createDataFrame([(1, 9), (2, 9), (2, 8)], "tag_id long, paper_id long")
    merged = spark.createDataFrame([(1, 1), (2, 1)], "tag_id long, keep_id long")
    n, m = upserts.fold_duplicates(notes_, members, merged)
    assert [r.insight for r in n.collect()] == ["newer"] and {(r.tag_id, r.paper_id) for r in m.collect()} == {(1, 9), (1, 8)}


def test_greedy_groups_follow_leaders():
    import numpy as np

    v = np.array([[1.0, 0.0], [0.0, 1.0], [0.95, 0.312], [0.8, 0.6]])
    assert graphs.leader_groups(["attention", "x", "주의", "y"], v, 0.88) == [0, 1, 0, 3]
    assert graphs.leader_groups(["a", "a", "b"], None) == [0, 0, 2]


def test_citations(spark):
    texts = spark.createDataFrame(
        [(1, "see 10.1000/abcdef and more"), (2, "we follow Attention is all you need, closely"), (3, "preattention is all you needed"), (4, "Convolutionalrepresentations"), (5, "nothing"), (6, "xx Electroencephalography datasets yy")],
        "id long, text string",
    )
    targets = spark.createDataFrame([(10, "Attention Is All You Need.", "10.1000/abc"), (11, "short", None), (12, "convolutionalrepresentation", None), (13, "electroencephalography dataset", None)], "id long, title string, doi string")
    found = {(r.source, r.target, r.provenance) for r in graphs.citations(texts, targets).collect()}
    assert found == {(1, 10, "doi"), (2, 10, "title"), (3, 10, "title"), (4, 12, "title"), (6, 13, "title")}


def test_long_dois_are_found(spark):
    doi = "10.1000/" + "a1" * 150
    texts = spark.createDataFrame([(1, f"see {doi}."), (2, f"see {doi[:-1]}."), (3, "see 10.1000/short")], "id long, text string")
    targets = spark.createDataFrame([(10, "x", doi), (11, "y", "10.1000/short")], "id long, title string, doi string")
    assert {(r.source, r.target, r.provenance) for r in graphs.citations(texts, targets).collect()} == {(1, 10, "doi"), (3, 11, "doi")}
    assert graphs.citations(texts, targets.withColumn("doi", graphs.F.lit(None).cast("string"))).count() == 0


def test_neighbourhood_keeps_the_distant_that_cite(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.43]), (3, [0.0, 1.0]), (99, [1.0, 0.0])], "id long, embedding array<float>")
    papers = spark.createDataFrame([(1, 2010), (2, 2005), (3, None)], "id long, year long")
    rel = spark.createDataFrame([(3, 1, "citation")], "source long, target long, relation_type string")
    out = {r.id: r for r in graphs.neighbourhood(v.where("id = 1").select("id"), v, papers, rel).collect()}
    assert set(out) == {2, 3} and out[3].similarity is None and out[3].cited and out[2].lineage == "precedent" and out[3].lineage == "concurrent"


def test_manual_edges_survive(spark):
    rel = spark.createDataFrame([(1, 2, "manual", 1.0), (1, 3, "semantic", 0.8), (2, 3, "semantic", 0.9)], "source long, target long, relation_type string, score double")
    new = spark.createDataFrame([(1, 4, 0.99)], "source long, target long, score double")
    out = {(r.source, r.target) for r in graphs.replace_semantic(rel, new, spark.createDataFrame([(1,)], "id long")).collect()}
    assert out == {(1, 2), (2, 3), (1, 4)}


def test_topics(spark):
    tags = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)], "tag_id long, paper_id long")
    assert [(r.a, r.b, r.weight) for r in graphs.cooccurrence(tags).collect()] == [(1, 2, 2.0)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.436])], "id long, embedding array<float>")
    kinds = {(r.a, r.b): r.kind for r in graphs.topic_edges(tags, v).collect()}
    assert kinds == {(1, 2): "cooccurrence", (1, 3): "semantic", (2, 3): "semantic"}
    nodes, edges = graphs.layout(spark.createDataFrame([(1, 4), (2, 2)], "id long, n_papers long"), graphs.cooccurrence(tags))
    assert [r["size"] for r in nodes.orderBy("id").collect()] == [46.0, 31.0] and edges.first()["width"] == 4.0


def test_job_states_agree_in_batch_and_stream(spark, tmp_path):
    import itertools

    events = list(itertools.product(range(40), range(5)))
    kinds, codes = ["claim", "fail", "complete", "retry", "cancel", "recover"], ["Network", "ProviderAuth", "Storage"]
    rows = [(j, s, kinds[(j * 7 + s * s) % 6] if s % 2 else "claim", codes[(j + s) % 3]) for j, s in events]
    df = spark.createDataFrame(rows, "job_id long, seq long, event string, error_code string")
    batch = {(r.job_id, r.status, r.attempts) for r in jobs.final_states(df).collect()}
    fold = {}
    for j, s, e, c in sorted(rows):
        fold[j] = changes.next_state(*fold.get(j, ("queued", 0)), e, c)
    assert batch == {(j, *s) for j, s in fold.items()}
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.job_states(stream).writeStream.format("memory").queryName("job_states").outputMode("update").start()
    try:
        q.processAllAvailable()
        assert {(r.job_id, r.status, r.attempts) for r in spark.table("job_states").collect()} == batch
    finally:
        q.stop()


def test_bursts_in_batch_and_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 500), ("a", 2000), ("b", 100)]
    df = spark.createDataFrame(rows, "path string, ms long").select("path", F.timestamp_millis("ms").alias("ts"))
    out = {(r.path, r.n) for r in changes.debounced(df, "path", "ts", "750 milliseconds").collect()}
    assert out == {("a", 2), ("a", 1), ("b", 1)}
    df.union(spark.createDataFrame([("z", 10**9)], "path string, ms long").select("path", F.timestamp_millis("ms"))).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.debounced(stream, "path", "ts", "750 milliseconds", watermark="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {(r.path, r.n) for r in spark.table("bursts").collect()} == out
    finally:
        q.stop()


def test_paths_are_flushed_after_silence_of_all(spark, tmp_path):
    rows = [("v", "a", 0), ("v", "b", 600), ("v", "a", 1200), ("v", "c", 3000), ("w", "a", 900)]
    df = spark.createDataFrame(rows, "vault string, path string, ms long").select("vault", "path", F.timestamp_millis("ms").alias("ts"))
    want = {("v", ("a", "b")), ("v", ("c",)), ("w", ("a",))}
    assert {(r.vault, tuple(r.paths)) for r in changes.debounced_paths(df, "ts", "750 milliseconds").collect()} == want
    df.union(spark.createDataFrame([("z", "z", 10**9)], "vault string, path string, ms long").select("vault", "path", F.timestamp_millis("ms"))).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.debounced_paths(stream, "ts", "750 milliseconds", watermark="1 second").writeStream.format("memory").queryName("flushed").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {(r.vault, tuple(r.paths)) for r in spark.table("flushed").collect()} == want
    finally:
        q.stop()


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 8])
def test_citations_by_any_doi_and_title(spark, automaton_bytes):
    long = "10.1000/" + "x" * 300
    texts = [("t1", f"see {long}. and hdl:abc/1234"), ("t2", "10." * 400_000), ("t3", "builds on: Dense Passage-Retrieval, for open!"), ("t4", "aDense passage retrieval for openb"), ("p3", "Dense passage retrieval for open"), ("t5", None), ("t6", "10.1/é日本 10.1/éx")]
    targets = [("p1", "t", long), ("p2", None, "hdl:abc/12"), ("p3", "Dense Passage Retrieval for Open", None), ("p4", "x", "10.1/é"), ("p5", "short title", "10.99")]
    found = graphs.citations(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(targets, "id string, title string, doi string"), automaton_bytes=automaton_bytes)
    assert {(r.source, r.target, r.provenance) for r in found.collect()} == {("t1", "p1", "doi"), ("t1", "p2", "doi"), ("t3", "p3", "title"), ("t4", "p3", "title"), ("t6", "p4", "doi")}


def plain_sentences(text):
    """Sentence ranges sign by sign."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?。！？":
            end = i + 1 + (text[i + 1 : i + 2] in tuple("\"')]”’"))
            after, number = text[end : end + 1], text[start : i + 1].strip()
            seen = text[end + 1 : end + 2] if after.isspace() else after
            decimal = text[max(i - 1, 0) : i].isdigit() and after.isdigit()
            digits = number[:-1] if number.endswith(".") else number
            numbered = digits != "" and all(part.isdigit() for part in digits.split("."))
            k = i + 1
            while k > start and (text[k - 1].isascii() and text[k - 1].isalpha() or text[k - 1] == "."):
                k -= 1
            short = text[k : i + 1].replace(".", "").lower() in documents.ABBREVIATIONS
            if not (decimal or numbered or short or "a" <= seen <= "z") and (not after or after.isspace()):
                out.append((start, end))
                start = end
            i = end
        else:
            i += 1
    return out + [(start, len(text))] * (start < len(text))


def test_sentences_of_all_documents_equal_plain_reading(spark, sf_dir):
    got = {}
    for r in documents.sentence_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect():
        got.setdefault(r.id, []).append((r.order_index, r.start, r.end))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert sorted(got.get(r.doc_id, [])) == [(n, a, b) for n, (a, b) in enumerate(plain_sentences(r.text or ""))]


def plain_tokens(text):
    wide = sum("\u1100" <= c <= "\u11ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" for c in text)
    return wide + (len(text) - wide + 3) // 4


def plain_units(pages):
    """Sentences with page and section, sign by sign."""
    section, out = None, []
    for number, text in pages:
        for line in text.split("\n"):
            bare = line.strip()
            name = bare.lower().lstrip("0123456789. ").strip()
            numbered = bare[:1].isdigit() and bare[:1].isascii() and " " in bare and len(bare.split()) <= documents.MAX_HEADING_WORDS
            if bare and len(bare.encode()) <= 80 and (name in documents.HEADINGS or numbered):
                section = bare
                continue
            held = ""
            for c in line.removesuffix("\r"):
                held += c
                if c in ".!?。！？" and len(held.strip().encode()) > 12:
                    out.append((held.strip(), number, section))
                    held = ""
            if held.strip():
                out.append((held.strip(), number, section))
    return out


def plain_chunks(pages, target=420, limit=480, overlap=60):
    units, chunks, at = plain_units(pages), [], 0
    while at < len(units):
        section, text, tokens, first, last, end = units[at][2], "", 0, units[at][1], units[at][1], at
        if plain_tokens(units[at][0]) > limit:
            size = target if plain_tokens(units[at][0]) > -(-len(units[at][0]) // 4) else 4 * target
            chunks += [(section, units[at][1], units[at][1], units[at][0][i : i + size]) for i in range(0, len(units[at][0]), size)]
            at += 1
            continue
        while end < len(units) and units[end][2] == section and (not text or tokens + plain_tokens(units[end][0]) <= target):
            text += " " * bool(text) + units[end][0]
            tokens += plain_tokens(units[end][0])
            first, last, end = min(first, units[end][1]), units[end][1], end + 1
        chunks.append((section, first, last, text))
        back, carried = end, 0
        while back > at + 1 and carried < overlap:
            back -= 1
            carried += plain_tokens(units[back][0])
        at = max(back, at + 1)
    return chunks


def test_chunks_of_all_documents_equal_plain_reading(spark, sf_dir):
    from sparkfolio.plans import model

    pages = model.pages(spark, sf_dir)
    got, given = {}, {}
    for r in documents.chunk_documents(pages).collect():
        got.setdefault(r.paper_id, []).append((r.chunk_no, (r.section, r.page_start, r.page_end, r.text), r.token_count))
    for r in pages.collect():
        given.setdefault(r.paper_id, []).append((r.page_number, r.text or ""))
    for paper, own in given.items():
        want = plain_chunks(sorted(own), documents.TARGET, documents.LIMIT, documents.OVERLAP)
        assert sorted(got.get(paper, [])) == [(n, c, plain_tokens(c[3])) for n, c in enumerate(want)]


def test_lines_of_units_end_at_newlines_only():
    assert [u.text for u in documents.units_of([(1, "One\x0cline of words here.\r\nAnother\u2028line of words.")])] == ["One\x0cline of words here.", "Another\u2028line of words."]


def test_enqueue_once(spark):
    wanted = spark.createDataFrame([(1, "embed", "1"), (1, "embed", "1"), (2, "relations", "1")], "paper_id long, kind string, version string")
    have = spark.createDataFrame([("2:relations:1",)], "idempotency_key string")
    assert [(r.idempotency_key, r.priority) for r in jobs.enqueue(have, wanted).collect()] == [("1:embed:1", 40)]
    assert changes.enqueued_once(wanted, "paper_id").count() == 2


def test_segments_map_to_sentences(spark):
    s = spark.createDataFrame([(1, 0, 0, "a", "One here."), (1, 1, 0, "b", "Two."), (1, 2, 1, "c", "Three.")], "page_id long, order_index long, paragraph_index long, id string, text string")
    source, ranges = translation.build_source(s)
    assert source.first().source == "One here. Two.\nThree."
    seg = spark.createDataFrame([(1, 0, "One here. Two.", "12"), (1, 1, "\n", " "), (1, 2, "Three.", "3"), (1, 3, "drift", "4")], "page_id long, segment_no long, original string, translated string")
    out = {r.segment_no: (r.sentence_ids, r.paragraph_index) for r in translation.map_segments(ranges, seg).collect()}
    assert out == {0: (["a", "b"], 0), 2: (["c"], 1), 3: (["c"], 1)}


def test_analysis(spark):
    good = {
        "schemaVersion": "1", "shortSummary": "s", "detailedSummary": "", "researchProblem": "p", "methodology": "m", "limitations": [], "keywords": ["k", " "], "followUpQuestions": [],
        "contributions": [{"claim": "c", "evidencePages": [2, 2, 99, 0, 1]}], "results": [], "suggestedTags": ["RAG", "a tag that is much too long to be one at all"],
        "tagInsights": [{"tag": "rag", "insight": "x", "evidencePages": [3]}, {"tag": "New", "insight": "y", "evidencePages": []}, {"tag": "blank", "insight": " "}],
    }
    rows = [(1, json.dumps(good), 10), (2, "no json", 10), (3, json.dumps(good | {"schemaVersion": "2"}), 10), (4, "```json\n" + json.dumps(good | {"shortSummary": " "}) + "\n```", 10)]
    out = {r.id: r for r in analysis.validate(spark.createDataFrame(rows, "id long, json string, page_count long")).collect()}
    assert [out[i].error for i in (1, 2, 3, 4)] == [None, "schema", "version", "empty summary"]
    a = out[1].analysis
    assert a.contributions[0].evidencePages == [1, 2] and a.keywords == ["k"] and a.suggestedTags == ["RAG", "New"] and len(a.tagInsights) == 2
    valid = analysis.validate(spark.createDataFrame(rows[:1], "id long, json string, page_count long"))
    shown = analysis.render(valid.withColumns({"title": F.lit("T"), "authors": F.array(F.lit("A"), F.lit("B")), "year": F.lit(2020), "venue": F.lit(None).cast("string"), "doi": F.lit("10.1/x"), "related": F.array(F.lit("R"))})).first().markdown
    assert shown.startswith("# T\n\nA, B · 2020 · DOI: 10.1/x\n\n## Summary\n\ns\n\n") and "- c (1p, 2p)" in shown and "#RAG #New" in shown and shown.endswith("- [[R]]\n")


def test_notes(spark):
    m = notes.Markers()
    paper = {"id": "p1", "title": 'A "fine" paper', "authors": ["X"], "year": 2020, "doi": None, "tags": ["t"]}
    first = notes.merge_note("", paper, "body", ["Other [x]"], "now", m)
    assert notes.merge_note(first, paper, "body", ["Other [x]"], "now", m) == first
    edited = first.replace("## My Notes", "## Mine\nkept").replace("tags:\n  - t", "tags:\n  - own\nrating: 5")
    again = notes.merge_note(edited, paper, "new body", [], "now", m)
    assert "kept" in again and "  - own" in again and "rating: 5" in again and "new body" in again and "Other" not in again
    assert notes.merge_note(first.replace(m.managed[1], ""), paper, "x", [], "now", m) is None
    df = spark.createDataFrame([("a.md", again), ("b.md", m.managed[1] + m.managed[0])], "path string, content string")
    parsed = notes.parsed_notes(df)
    out = notes.pulled(parsed, spark.createDataFrame([], "name string"))
    assert [r.tag for r in out["paper_tags"].collect()] == ["own"] and [r.path for r in out["conflicts"].collect()] == ["b.md"]


def test_import(spark):
    ok = b"%PDF-1.7 x %%EOF"
    files = [("a_b.pdf", ok), ("c.pdf", ok), ("d.pdf", b"no"), ("e.pdf", b"%PDF-1"), ("f.pdf", b"%PDF-/Encrypt %%EOF"), ("g.pdf", b""), ("h.pdf", b"%PDF-2 %%EOF")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    known = spark.createDataFrame([(7,)], "id long").withColumn("sha256", F.sha2(F.lit(b"%PDF-2 %%EOF"), 256))
    out = {r.path: r for r in importing.outcomes(df, known).collect()}
    assert [out[p].outcome for p, _ in files] == ["imported", "duplicate", "rejected", "rejected", "rejected", "rejected", "duplicate"]
    assert [out[p].reason for p in ("d.pdf", "e.pdf", "f.pdf", "g.pdf")] == ["signature", "truncated", "encrypted", "empty"] and out["h.pdf"].paper_id == "7" and out["a_b.pdf"].title == "a b"
    report = importing.outcomes(df, known)
    assert importing.to_enqueue(report).count() == 2 and importing.memberships(report, "g").count() == 2


def test_records(spark):
    text = "data: {\"a\": \"é\"}\n\n: note\ndata: [DONE]\ndata: last".encode()
    parts = [(1, i, bytearray(text[i : i + 3])) for i in range(0, len(text), 3)]
    df = spark.createDataFrame(parts, "stream_id long, seq long, chunk binary")
    assert [r.data for r in records.sse_events(df).collect()] == ['{"a": "é"}']
    seg = records.translation_segments(spark.createDataFrame([('[[["안녕","hi",null],["!","!"],[null,"x"]],null,"en"]',)], "json string")).collect()
    assert [(r.translated, r.original) for r in seg] == [("안녕", "hi"), ("!", "!")]
    wait = spark.createDataFrame([(429, 1, 7), (500, 2, None), (404, 1, None), (503, 3, None), (429, 1, 99)], "s int, n int, r int").select(records.retry_wait(F.col("s"), F.col("n"), F.col("r")))
    assert [r[0] for r in wait.collect()] == [7, 4, None, None, 30]


def test_two_columns_are_read_one_after_the_other(spark):
    rows, no = [], 0
    for line in range(20):
        for x, side in ((0.1, "L"), (0.55, "R")):
            rows.append((1, 1, no, f"{side}{line} ends here.", x, 0.1 + line * 0.03, 0.3, 0.02, 100.0 + line * 14, 12.0, x * 600))
            no += 1
    rows.append((1, 1, no, "A footnote", 0.1, 0.95, 0.2, 0.01, 700.0, 6.0, 60.0))
    items = spark.createDataFrame(rows, "paper_id long, page_number long, item_no long, text string, x double, y double, width double, height double, baseline double, height_pt double, left_pt double")
    lines = layout.page_lines(items)
    order = [r.text[0] for r in lines.orderBy("column", "line_no").collect()]
    assert order == ["L"] * 20 + ["R"] * 20 + ["A"]
    assert layout.paragraph_texts(lines).count() >= 3
    assert layout.joined_lines(["edu-", "cators say"])[0] == "educators say"
    title = spark.createDataFrame([(1, 1, 0, "A Large Title", 0.1, 0.1, 0.5, 0.05, 50.0, 30.0, 60.0), *[(1, 1, i, "body text", 0.1, 0.2 + i * 0.03, 0.5, 0.02, 100.0 + i * 20, 12.0, 60.0) for i in range(1, 8)]], items.schema)
    assert layout.layout_titles(title).first().title == "A Large Title"
    point = spark.createDataFrame([(1, 1, 5, 0.2, 0.11)], "paper_id long, page_number long, point_id long, px double, py double")
    assert layout.word_at(title, point).first().text == "Large"
    clip = layout.clip_to_glyphs(spark.createDataFrame([(1, 1, 0, 0.0, 0.1, 0.9, 0.05)], "paper_id long, page_number long, rect_no long, x double, y double, width double, height double"), title)
    assert round(clip.first().x, 3) == 0.1 and round(clip.first().width, 3) == 0.5


def test_embedding_hooks(spark):
    from sparkfolio.operators import embedding

    df = embedding.embed(spark.createDataFrame([("a b",), (None,)], "text string"), "text", dim=16, model=lambda t: embedding.hashed(t, 16))
    blobs = embedding.from_blob(embedding.to_blob(df, "embedding").drop("embedding"), "blob")
    assert [r.embedding for r in blobs.collect()] == [r.embedding for r in df.collect()]

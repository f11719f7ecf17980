import random

import pytest

from sparkfolio.operators import translation
from sparkfolio.sources import records
from sparkfolio.streaming.changes import EventLines, event_stream

TEXT = "data: héllo wörld 日本\n\n: note\r\ndata:  😀 \r\ndata:\ndata: {\"a\": \"é\"}\n\nevent: x\ndata: last\ndata: [DONE]\ndata: after\n"
WANT = [(0, "héllo wörld 日本"), (1, "😀"), (2, '{"a": "é"}'), (3, "last")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_bytes_cut_anywhere(size):
    raw, reader, out = TEXT.encode(), EventLines(), []
    for i in range(0, len(raw), size):
        out += reader.read(raw[i : i + size])
        reader = EventLines(reader.kept, reader.number, reader.ended)  # as kept between batches
    assert out == WANT and reader.ended


def test_stream_of_batches_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for stream in range(4):
        raw = (TEXT if stream else TEXT.replace("data: [DONE]\ndata: after\n", "data: half")).encode()
        cuts = sorted(rng.sample(range(1, len(raw)), 12))
        rows += [(stream, n, raw[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)]))]
    rows += [(9, 0, b"data: one\nda"), (9, 1, None), (9, 2, b"ta: two\n")]
    schema = "stream_id long, seq long, chunk binary"
    for batch in range(3):  # chunks of all streams, split over three batches
        part = [r for r in rows if (r[1] // 5 if r[0] != 9 else r[1]) == batch]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("events_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.sql("select * from events_out").collect()))
    want = sorted([(s, *e) for s in range(4) for e in WANT] + [(9, 0, "one")])
    assert got == want
    whole = spark.createDataFrame([r for r in rows if r[0] == 0], schema)
    assert [(r.event_no, r.data) for r in records.sse_events(whole).orderBy("event_no").collect()] == WANT


def plain_segments(sentences, segments):
    """(segment_no, ids, paragraph) of one page, each segment against each sentence."""
    at, out = 0, []
    for no, original, text in segments:
        a, b = at, at + len(original)
        at = b
        if not text.strip(" "):
            continue
        hit = [s for s in sentences if s[0] < b and s[1] > a]
        if not hit:
            hit = [s for s in sentences if s[0] <= a][-1:]
        out.append((no, [s[2] for s in hit], hit[0][3] if hit else 0))
    return out


def test_segments_of_many_sentences(spark):
    rng = random.Random(2)
    sentences, at = [], 5
    for i in range(600):
        n = rng.choice([0, 3, 40, 3000 if i % 100 == 0 else 20])
        sentences.append((at, at + n, f"s{i}", i // 7))
        at += n + rng.choice([0, 1, 30])
    segments = [(i, "x" * rng.choice([0, 1, 10, 60, 2500 if i % 50 == 0 else 30]), rng.choice(["t", " ", "u"])) for i in range(500)]
    ranges = spark.createDataFrame([(1, i, p, s, a, b) for i, (a, b, s, p) in enumerate(sentences)], "page_id long, order_index int, paragraph_index int, id string, start long, end long")
    rows = spark.createDataFrame([(1, *s) for s in segments], "page_id long, segment_no int, original string, translated string")
    got = sorted((r.segment_no, list(r.sentence_ids), r.paragraph_index) for r in translation.map_segments(ranges, rows).collect())
    assert got == plain_segments(sentences, segments)

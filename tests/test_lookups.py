import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import lookups
from sparkfolio.sources import schemas

RECTS = schemas.RECTS


def test_schemas(spark):
    assert "title_source" in schemas.schema("papers").names and "title_source" not in schemas.schema("papers", 5).names
    assert schemas.schema("sentences").names[-1] == "paragraph_index"
    with pytest.raises(KeyError):
        schemas.schema("topics", 3)


def test_old_rows_are_migrated(spark, tmp_path):
    old = spark.createDataFrame([("a", "t", "g")], "topic_id string, paper_id string, extra string")
    assert schemas.migrated(old, "paper_topics").columns == ["topic_id", "paper_id"]
    assert schemas.migrated(spark.createDataFrame([("p",)], "id string"), "papers").first().title_source is None
    old.select("topic_id", "paper_id").write.parquet(str(tmp_path / "paper_topics"))
    assert schemas.read(spark, str(tmp_path), "paper_topics").count() == 1


def test_word_deletion_splits_a_highlight(spark):
    h = spark.createDataFrame([(1, [(0.1, 0.5, 0.8, 0.02)]), (2, [(0.4, 0.5, 0.1, 0.02)]), (3, [(0.1, 0.1, 0.2, 0.02)])], f"id long, rects {RECTS}")
    word = F.struct(F.lit(0.4).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("width"), F.lit(0.02).alias("height"))
    out = sorted((r.id, r.part) for r in lookups.without_word(h, word).collect())
    assert out == [(1, 0), (1, 1), (3, 0)]


def test_rectangles_of_a_selection(spark):
    s = spark.createDataFrame([("a", [(0.1, 0.1, 0.1, 0.1)]), ("b", [(0.2, 0.1, 0.1, 0.1), (0.3, 0.1, 0.1, 0.1)])], f"id string, rects {RECTS}")
    sel = spark.createDataFrame([(1, ["b", "gone", "a"])], "selection_id long, sentence_ids array<string>")
    assert [r["x"] for r in lookups.rects_of(sel, s).first().rects] == [0.2, 0.3, 0.1]


def test_colors_and_keys(spark):
    h = spark.createDataFrame([(1, "yellow"), (2, "#ff0000"), (3, None)], "id long, color string")
    assert [r.rejected for r in lookups.checked_colors(h).orderBy("id").collect()] == [False, True, True]
    assert lookups.by_key(h, id=2).count() == 1 and lookups.by_key(h, id=9).count() == 0 and lookups.by_key(h, color=None).first().id == 3


def test_notes_are_written_and_watched(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "é"), ("sub/b.md", "x")], "path string, content string")
    assert {(r.path, r.bytes) for r in lookups.write_notes(notes, f"file://{tmp_path}").collect()} == {("a.md", 2), ("sub/b.md", 1)}
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["a.md", "b.md"]
    q = lookups.watched_notes(spark, str(tmp_path)).writeStream.format("memory").queryName("watched").start()
    try:
        q.processAllAvailable()
        assert {r.content for r in spark.table("watched").collect()} == {"é", "x"}
    finally:
        q.stop()


def test_stages_are_cleared(spark, tmp_path, monkeypatch):
    from sparkfolio import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    path = session.stage_path(spark, "rows")
    spark.range(3).write.parquet(path)
    own = tmp_path / "shared" / spark.sparkContext.applicationId
    assert spark.read.parquet(path).count() == 3 and own.exists()
    session.clear_stages(spark)
    assert not own.exists()

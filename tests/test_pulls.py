from sparkfolio.sources import versions
from sparkfolio.streaming import pulls

NOTE = "---\npaper_id: \"{}\"\ngroups:\n{}tags:\n{}---\nbody\n"


def note(paper, groups, tags):
    items = lambda xs: "".join(f"  - {x}\n" for x in xs)
    return NOTE.format(paper, items(groups), items(tags))


DAMAGED = "---\npaper_id: \"p1\"\n---\n<!-- user:end -->\n<!-- user:start -->\n"
BATCHES = [
    [("a.md", note("p1", ["Old", "New"], ["x", "y"]), 1), ("a.md", note("p1", ["Old"], ["x"]), 0), ("b.md", note("p2", [], ["z"]), 1), ("c.md", note("gone", ["Never"], ["q"]), 1), ("d.md", "no frontmatter", 1)],
    [("a.md", DAMAGED, 2), ("b.md", note("p2", ["Other"], []), 2), ("e.md", None, 2)],
    [("a.md", note("p1", ["New"], ["w"]), 3)],
]
SCHEMA = "path string, content string, at long"


def state(snapshot):
    return {name: sorted(map(tuple, snapshot.table(name).drop("revision").collect())) for name in pulls.TABLES}


def expected(batches):
    out = {"groups": [("New",), ("Old",)], "paper_groups": [("p1", "New"), ("p1", "Old")], "paper_tags": [("p1", "x"), ("p1", "y"), ("p2", "z")], "sync": [("p1", "a.md", "synced"), ("p2", "b.md", "synced")]}
    if batches > 1:
        out |= {"groups": [("New",), ("Old",), ("Other",)], "paper_groups": [("p1", "New"), ("p1", "Old"), ("p2", "Other")], "paper_tags": [("p1", "x"), ("p1", "y")], "sync": [("p1", "a.md", "conflict"), ("p2", "b.md", "synced")]}
    if batches > 2:
        out |= {"paper_groups": [("p1", "New"), ("p2", "Other")], "paper_tags": [("p1", "w")], "sync": [("p1", "a.md", "synced"), ("p2", "b.md", "synced")]}
    return out | {"papers": [("p1",), ("p2",), ("p3",)], "batches": [("vault", batches - 1)]}


def made(spark, root):
    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")
    sync = spark.createDataFrame([("p1", "a.md", "r", "synced"), ("p2", "b.md", "r", "synced")], pulls.SYNC)
    return pulls.library(spark, root, papers, spark.createDataFrame([("Old",)], "name string"), sync)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "library")
    made(spark, root)
    for n, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, SCHEMA)
        assert pulls.pull(batch, n, root)
        now = versions.opened(spark, root)
        assert state(now) == expected(n + 1)
        assert not pulls.pull(batch, n, root)  # sent again
        assert not pulls.pull(spark.createDataFrame(BATCHES[0], SCHEMA), 0, root)  # and an earlier one
        assert versions.opened(spark, root).version == now.version


def test_stream_of_changed_notes(spark, tmp_path):
    root = str(tmp_path / "library")
    made(spark, root)
    for rows in BATCHES[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(pulls.puller(root)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert state(versions.opened(spark, root)) == expected(2)

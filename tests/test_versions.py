import random
from collections import Counter

import pytest

from sparkfolio.sources import versions
from sparkfolio.sources.versions import Change, Conflict, commit, opened, vacuum


def rows(df):
    return Counter(map(tuple, df.collect()))


def frame(spark, data):
    return spark.createDataFrame(data, "k long, v string")


def test_random_commits_of_two_tables(spark, tmp_path):
    rng = random.Random(1)
    snapshot, tables = opened(spark, str(tmp_path / "t")), {"a": Counter(), "b": Counter()}
    seen = []
    for step in range(5):
        changes = {}
        for name in ("a", "b") if step != 2 else ("b",):
            new = [(rng.choice([None, *range(40)]), f"{name}{step}-{i}") for i in range(rng.choice([0, 3, 25]) if step else 30)]
            gone = [(rng.randrange(40),) for _ in range(step)]
            changes[name] = Change("k", frame(spark, new).repartition(3), spark.createDataFrame(gone, "k long"))
            drop = {k for k, _ in new} | {k for (k,) in gone}
            tables[name] = Counter({r: n for r, n in tables[name].items() if r[0] not in drop}) + Counter(new)
        snapshot = commit(snapshot, changes)
        seen.append((snapshot, dict(tables)))
    for old, state in seen:  # readers of old versions are unharmed
        assert {n: rows(old.table(n)) for n in ("a", "b")} == state
    assert opened(spark, str(tmp_path / "t")).version == 4 and snapshot.names() == ["a", "b"]
    assert vacuum(spark, str(tmp_path / "t"), keep=2) > 0
    for old, state in seen[-2:]:
        assert {n: rows(old.table(n)) for n in ("a", "b")} == state
    assert versions.versions(spark, str(tmp_path / "t")) == [3, 4]


def test_untouched_files_stay(spark, tmp_path):
    base = opened(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else rows this few make one file
    try:
        first = commit(base, {"a": Change("k", frame(spark, [(i, "x" * 50) for i in range(400)]).repartition(4))})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert first.files("a").where("path is not null").count() > 1
    second = commit(first, {"a": Change("k", frame(spark, [(7, "new")]))})
    paths = [{r.path for r in s.files("a").collect()} for s in (first, second)]
    assert len(paths[0] - paths[1]) == 1 and rows(second.table("a"))[7, "new"] == 1 and second.table("a").count() == 400


def test_what_fails_leaves_nothing_visible(spark, tmp_path):
    base = commit(opened(spark, str(tmp_path / "t")), {"a": Change("k", frame(spark, [(1, "x")])), "b": Change("k", frame(spark, [(1, "y")]))})
    broken = frame(spark, [(2, "z")]).selectExpr("k", "cast(raise_error('no') as string) as v")
    with pytest.raises(Exception, match="no"):
        commit(base, {"a": Change("k", frame(spark, [(1, "changed")])), "b": Change("k", broken)})
    now = opened(spark, str(tmp_path / "t"))
    assert now.version == base.version and rows(now.table("a")) == Counter([(1, "x")])


def test_commits_from_one_base_conflict(spark, tmp_path):
    base = opened(spark, str(tmp_path / "t"))
    commit(base, {"a": Change("k", frame(spark, [(1, "x")]))})
    with pytest.raises(Conflict):
        commit(base, {"a": Change("k", frame(spark, [(1, "y")]))})
    assert rows(opened(spark, str(tmp_path / "t")).table("a")) == Counter([(1, "x")])


def test_table_without_rows(spark, tmp_path):
    one = commit(opened(spark, str(tmp_path / "t")), {"a": Change("k", frame(spark, [(1, "x")]))})
    two = commit(one, {"a": Change("k", replaced=spark.createDataFrame([(1,)], "k long"))})
    assert two.table("a").columns == ["k", "v"] and two.table("a").count() == 0
    three = commit(two, {"a": Change("k", frame(spark, [(5, "back")]))})
    assert rows(three.table("a")) == Counter([(5, "back")])
    with pytest.raises(KeyError):
        three.table("nothing")

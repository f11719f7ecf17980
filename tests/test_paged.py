import json
import os
import time

import pytest

from sparkfolio.sources import paged
from sparkfolio.sources.paged import Answer


def transport(folder, total):
    """Answers pages of invented records and notes each request in a folder; offset 40 fails once, 60 twice."""

    def ask(request):
        name = f"{request['offset']}-{time.time_ns()}-{os.getpid()}"
        tries = sum(f.startswith(request["offset"] + "-") for f in os.listdir(folder))
        with open(f"{folder}/{name}", "w") as f:
            json.dump(request | {"at": time.time()}, f)
        if (request["offset"] == "40" and tries < 1) or (request["offset"] == "60" and tries < 2):
            return Answer(429 if tries else 503, retry_after=0)
        offset, limit = int(request["offset"]), int(request["limit"])
        rows = [{"id": i, "year": 2000 + i % 20 if i % 7 else None, "isOpenAccess": i % 2 == 0} for i in range(offset, min(offset + limit, total))]
        return Answer(200, json.dumps({"total": total, "data": rows}))

    return ask


def requests(folder):
    return [json.loads(open(f"{folder}/{f}").read()) for f in os.listdir(folder)]


def test_pages_retries_and_the_gate(spark, tmp_path):
    name = paged.register(spark, transport(str(tmp_path), 95), "paged_test")
    found = spark.read.format(name).option("query", "graphs").option("limit", 20).option("seconds", 0.3).load()
    rows = found.collect()
    assert sorted(json.loads(r.record)["id"] for r in rows) == list(range(95))
    assert all(r.offset + r.position == json.loads(r.record)["id"] for r in rows)
    asked = requests(tmp_path)
    assert sorted(int(r["offset"]) for r in asked) == [0, 20, 40, 40, 60, 60, 60, 80]
    times = sorted(r["at"] for r in asked if r["offset"] != "0")
    assert all(b - a > 0.1 for a, b in zip(times, times[1:]))  # retries included, from whichever task


def test_turns_of_the_gate():
    for now in (0.0, 0.1, 7.3, 100.9):
        turns = [now + paged.until_turn(i, 5, 0.5, now) for i in range(5)]
        assert min(turns) >= now and max(turns) <= now + 3 and len({round(t / 0.5) for t in turns}) == 5
    assert paged.until_turn(3, 5, 0, 1.0) == 0


def test_filters_go_with_the_request(spark, tmp_path):
    name = paged.register(spark, transport(str(tmp_path), 30), "paged_filters")
    found = spark.read.format(name).option("query", "q").option("seconds", 0).load().where("year >= 2005 and year < 2010 and is_open_access = true")
    assert {r.year for r in found.collect()} <= set(range(2005, 2010)) and found.where("not is_open_access").count() == 0
    assert {(r.get("year_from"), r.get("year_to"), r.get("open_access")) for r in requests(tmp_path)} == {("2005", "2009", "true")}


def test_no_more_than_a_thousand_hits(spark, tmp_path):
    name = paged.register(spark, transport(str(tmp_path), 5000), "paged_many")
    found = spark.read.format(name).option("query", "q").option("seconds", 0).option("limit", 90).load()
    assert found.count() == 1000
    assert max(int(r["offset"]) for r in requests(tmp_path)) == 990


def test_waits_and_giving_up():
    waits = []
    answers = iter([Answer(503), Answer(429, retry_after=7), Answer(200, '{"total": 0}')])
    assert paged.answered(lambda r: next(answers), {"offset": "0"}, waits.append) == {"total": 0} and waits == [2, 7]
    for status, tries in ((404, 1), (500, 3)):
        asked = []
        with pytest.raises(paged.Refused):
            paged.answered(lambda r: asked.append(r) or Answer(status), {"offset": "0"}, lambda s: None)
        assert len(asked) == tries
    assert paged.wait_before(Answer(429, retry_after=100), 1) == 30


def test_downloads_are_bounded():
    parts = lambda url: iter([b"x" * 10] * 5)
    assert len(paged.downloaded(parts, "https://a", 50)) == 50
    for url, most in (("https://a", 49), ("http://a", 100)):
        with pytest.raises(ValueError):
            paged.downloaded(parts, url, most)

"""A paged search as a data source: pages are partitions, filters on years and access go with the requests, and one rate gate
holds for all tasks."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Hits that a search gives access to, and those of a page.
MOST_HITS, MOST_PAGE = 1000, 100
ATTEMPTS, LONGEST_WAIT = 3, 30
SCHEMA = "offset long, position int, year int, is_open_access boolean, record string"


@dataclass(frozen=True)
class Answer:
    """What a transport returns: body is JSON with ``total`` and ``data``, a list of records."""

    status: int
    body: str = ""
    retry_after: float | None = None


#: From parameters of a request (query, offset, limit, and perhaps year_from, year_to, open_access) to its answer.
Transport = Callable[[dict[str, str]], Answer]


class Refused(RuntimeError):
    """A request that failed for good."""


def wait_before(answer: Answer, attempt: int) -> float | None:
    """Seconds to wait before the next attempt, None to give up: for 429 and 5xx only, as told or doubling, 1 to 30."""
    if attempt >= ATTEMPTS or not (answer.status == 429 or answer.status >= 500):
        return None
    return min(LONGEST_WAIT, max(1, answer.retry_after if answer.retry_after is not None else 2**attempt))


def until_turn(place: int, places: int, seconds: float, now: float) -> float:
    """Seconds until the next turn of one of several pages: time is cut into slots of ``seconds``, which belong to the pages in turn."""
    if not seconds:
        return 0.0
    slot = math.ceil(now / seconds)
    return (slot + (place - slot) % places) * seconds - now


def answered(transport: Transport, request: dict[str, str], sleep: Callable[[float], None] = time.sleep, gate: Callable[[], float] = lambda: 0.0) -> dict:
    """A page as parsed JSON, after as many attempts as the rule allows, each let through by the gate, which tells how long to wait."""
    attempt = 1
    while True:
        if (turn := gate()) > 0:
            sleep(turn)
        answer = transport(request)
        if answer.status == 200:
            return json.loads(answer.body)
        if (wait := wait_before(answer, attempt)) is None:
            raise Refused(f"status {answer.status} for offset {request['offset']} after {attempt} attempts")
        sleep(wait)
        attempt += 1


@dataclass
class Page(InputPartition):
    """A page, and its place among all at the gate."""

    offset: int
    place: int
    places: int
    known: str | None = None

    def __post_init__(self) -> None:
        super().__init__(self.offset)


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, options: dict[str, str]):
        self.transport = transport
        self.limit = min(MOST_PAGE, max(1, int(options.get("limit", MOST_PAGE))))
        self.seconds = float(options.get("seconds", 1))
        self.request = {"query": options["query"]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Bounds of years and open access become parameters; other filters are left to Spark."""
        low, high = [], []
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column == "year" and isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                low.append(f.value + isinstance(f, GreaterThan))
            elif column == "year" and isinstance(f, (LessThanOrEqual, LessThan)):
                high.append(f.value - isinstance(f, LessThan))
            elif column == "year" and isinstance(f, EqualTo):
                low.append(f.value)
                high.append(f.value)
            elif column == "is_open_access" and isinstance(f, EqualTo) and f.value is True:
                self.request["open_access"] = "true"
            yield f  # a server's reading of them may be wider: Spark applies them again
        if low:
            self.request["year_from"] = str(max(low))
        if high:
            self.request["year_to"] = str(min(high))

    def _params(self, offset: int) -> dict[str, str]:
        return self.request | {"offset": str(offset), "limit": str(self.limit)}

    def partitions(self) -> list[InputPartition]:
        """The first page is asked for here, as it tells the total; each later one gets its own place at the gate."""
        first = answered(self.transport, self._params(0))
        offsets = range(self.limit, min(int(first.get("total") or 0), MOST_HITS), self.limit)
        return [Page(0, 0, 1, json.dumps(first)), *(Page(o, i, len(offsets)) for i, o in enumerate(offsets))]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.known is not None:
            page = json.loads(partition.known)
        else:
            # No two pages have the same turns, so tasks keep the rate without talking to each other, whenever they start.
            page = answered(self.transport, self._params(partition.offset), gate=lambda: until_turn(partition.place, partition.places, self.seconds, time.time()))
        for n, record in enumerate(page.get("data") or []):
            if partition.offset + n < MOST_HITS:
                year = record.get("year")
                yield partition.offset, n, int(year) if year is not None else None, bool(record.get("isOpenAccess")), json.dumps(record)


def register(spark: SparkSession, transport: Transport, name: str = "paged_search") -> str:
    """Registers a search under a name for ``spark.read.format(name).option("query", ...)``; options: query, limit (1 to 100), seconds (between
    requests).  Rows are SCHEMA's.  A page that fails for good fails the read."""

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(transport, dict(self.options))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Search)
    return name


def downloaded(get: Callable[[str], Iterator[bytes]], url: str, most: int) -> bytes:
    """The bytes at an HTTPS address, given in parts by ``get``; ValueError for other addresses, and as soon as more than ``most`` came."""
    if not url.lower().startswith("https://"):
        raise ValueError("only HTTPS addresses are downloaded")
    parts, size = [], 0
    for part in get(url):
        size += len(part)
        if size > most:
            raise ValueError(f"more than {most} bytes")
        parts.append(part)
    return b"".join(parts)

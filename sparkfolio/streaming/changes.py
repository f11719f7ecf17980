"""Streams: bursts of changes are one, repeated jobs are one, and jobs' events are folded as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.operators.jobs import MAX_ATTEMPTS, RETRY_CODES, WAIT_CODES


def debounced(events: DataFrame, key: str, time: str, quiet: str, watermark: str | None = None) -> DataFrame:
    """Rows (key, start, last, n): bursts of a key's events, ended by a quiet time. The same on a table and on a stream; a
    stream needs a watermark, after which a burst is given out."""
    if watermark:
        events = events.withWatermark(time, watermark)
    bursts = events.groupBy(key, F.session_window(time, quiet).alias("burst"))
    return bursts.agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n")).drop("burst")


def debounced_paths(events: DataFrame, time: str, quiet: str, path: str = "path", by: str = "vault", watermark: str | None = None) -> DataFrame:
    """Rows (by, start, last, paths): the distinct paths that changed in each burst over all events of a vault, as its watcher
    flushes them after a quiet time. The same on a table and on a stream. A vault's events meet, as one watcher sees them all."""
    if watermark:
        events = events.withWatermark(time, watermark)
    bursts = events.groupBy(by, F.session_window(time, quiet).alias("burst"))
    return bursts.agg(F.min(time).alias("start"), F.max(time).alias("last"), F.sort_array(F.collect_set(path)).alias("paths")).drop("burst")


def enqueued_once(wanted: DataFrame, key: str, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Jobs by idempotency key, each once; on a stream within the watermark."""
    if time and watermark:
        return wanted.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
    return wanted.dropDuplicates([key])


def next_state(status: str, attempts: int, event: str, code: str | None, most: int = MAX_ATTEMPTS) -> tuple[str, int]:
    """A job's state after an event; events that its state doesn't allow change nothing."""
    if event == "claim" and status == "queued":
        return "running", attempts + 1
    if event == "complete" and status == "running":
        return "completed", attempts
    if event == "fail" and status == "running":
        return ("waiting_for_key" if code in WAIT_CODES else "queued" if code in RETRY_CODES and attempts < most else "failed"), attempts
    if event == "retry" and status in ("failed", "waiting_for_key"):
        return "queued", 0
    if event == "cancel" and status in ("queued", "waiting_for_key"):
        return "cancelled", attempts
    if event == "recover" and status == "running":
        return "queued", attempts
    return status, attempts


def job_states(events: DataFrame) -> DataFrame:
    """Rows (job_id, status, attempts) after each batch of a stream of events (job_id, seq, event, error_code)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for event, code in zip(rows["event"], rows["error_code"]):
            status, attempts = next_state(status, attempts, event, code)
        state.update((status, attempts))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, attempts long", "status string, attempts long", "update", "NoTimeout")


class EventLines:
    """Data of one event stream, from its bytes as they come: what isn't decoded and what isn't a whole line yet is kept.

    A stream ends at its end mark, and what comes later is not read. ``kept`` is all that a later batch needs.
    """

    END = "[DONE]"

    def __init__(self, kept: bytes = b"", number: int = 0, ended: bool = False):
        self.kept, self.number, self.ended = kept, number, ended

    def read(self, chunk: bytes) -> list[tuple[int, str]]:
        """Numbers and data of the events that a chunk completes."""
        out: list[tuple[int, str]] = []
        *lines, self.kept = (self.kept + chunk).split(b"\n")  # no byte of another character is a line end
        for line in lines:
            text = line.removesuffix(b"\r").decode("utf-8", "replace")
            if self.ended or not text.startswith("data:"):
                continue
            data = text[5:].strip(" ")
            if data == self.END:
                self.ended = True
            elif data:
                out.append((self.number, data))
                self.number += 1
        if self.ended:
            self.kept = b""
        return out


def event_stream(chunks: DataFrame) -> DataFrame:
    """Rows (stream_id, event_no, data) of a stream of chunks (stream_id, seq, chunk): the events that each batch completes.

    Characters and lines may be cut anywhere, between batches too.  A stream's chunks come in order of ``seq``; those of one
    batch are sorted.  A chunk that is null cancels its stream: what is kept of it is dropped, and nothing more is read.
    """
    import pyarrow as pa  # noqa: F401  the state's rows are exchanged through it

    def decode(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reader = EventLines(*state.get) if state.exists else EventLines()
        rows = pd.concat(list(frames)).sort_values("seq")
        found: list[tuple[int, str]] = []
        for chunk in rows["chunk"]:
            if chunk is None:
                reader.kept, reader.ended = b"", True
            elif not reader.ended:
                found += reader.read(bytes(chunk))
        state.update((bytes(reader.kept), reader.number, reader.ended))
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "event_no": [n for n, _ in found], "data": [d for _, d in found]}).astype({"event_no": "int64"})

    from pyspark.sql.streaming.state import GroupStateTimeout

    id_type = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(decode, f"stream_id {id_type}, event_no long, data string", "kept binary, number long, ended boolean", "append", GroupStateTimeout.NoTimeout)

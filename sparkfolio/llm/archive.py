"""WARC records in ZIP-packaged archives: writing, and reading by range without extraction.

Each task writes one archive: a ZIP whose members are stored, not packed: ``archive/data.warc.gz`` holds one gzip member
per record, ``indexes/index.cdxj`` a line per record with its place in the former.  The reader parses the end record, the
ZIP64 end record and the central directory, finds the stored members and the index, and reads records by byte ranges.  It
reads others' archives too: any number of WARC members, index lines with keys before their JSON, packed indexes, archives
without an index, records with any ids and header cases.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.shared import stage_path, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(path: str):
    """The file system of a path (local, HDFS, object stores) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


# -- records ----------------------------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC 1.1 record of this id. One that refers to another is a revisit: it holds the HTTP headers of the full payload and
    no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts; a line that begins with white space goes on from the last."""
    pairs: list[list[str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and pairs:
            pairs[-1][1] += " " + text.strip()
        else:
            key, _, value = text.partition(":")
            pairs.append([key.strip().lower(), value.strip()])
    return {k: v for k, v in reversed(pairs)}


def parse_record(raw: bytes) -> dict:
    """Fields of a record; raises where its block is cut off, or a payload doesn't have the SHA-1 that its header names.

    The payload is what follows the HTTP headers, or the whole block of a record that holds no HTTP message.  Its digest is
    taken where the header names none, and isn't compared where a transfer coding, a truncation or another hash stands
    between.  A revisit has no payload: its size is what its HTTP headers say, null if nothing.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    fields = _fields(lines)
    size = int(fields["content-length"])
    block, kind, name = rest[:size], fields.get("warc-type", ""), fields.get("warc-record-id", "")
    if len(block) < size:
        raise ValueError(f"record {name} is cut off")
    http, payload, revisit = {}, block, kind == "revisit"
    if block.startswith(b"HTTP/") or fields.get("content-type", "").lower().startswith("application/http"):
        message, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(message.split(b"\r\n")[1:])
    algorithm, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    own = payload_digest(payload)
    if not revisit and digest and algorithm.lower() in ("sha1", "") and digest.upper() != own and "transfer-encoding" not in http and "warc-truncated" not in fields:
        raise ValueError(f"damaged payload in record {name}")
    told = http.get("content-length", "")
    return {
        "record_id": name,
        "url": fields.get("warc-target-uri", ""),
        "payload_bytes": (int(told) if told.isdigit() else None) if revisit else len(payload),
        "payload_digest": digest or (None if revisit else own),
        "record_type": kind,
        "refers_to": fields.get("warc-refers-to") if revisit else None,
        "payload": None if revisit else payload,
    }


# -- ZIP directories --------------------------------------------------------------------------------------------------


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of each stored member. read(offset, length) gives bytes of an archive of ``size`` bytes."""
    return {name: (at, n) for name, (at, n, packed) in all_members(read, size).items() if not packed}


def all_members(read, size: int) -> dict[str, tuple[int, int, bool]]:
    """Offset, length in the archive and whether it is deflated, of each stored or deflated member."""
    tail_at = max(0, size - 65_557 - 20)  # end record with the longest comment, and the ZIP64 locator before it
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        full = read(at, 56)
        if full[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, offset = struct.unpack_from("<QQQ", full, 32)
    directory, at, found = read(offset, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack_from("<H8xIIHHH8xI", directory, at + 10)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        place = 0
        while place + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, place)
            if kind == 1:  # ZIP64: 8 bytes for each field whose 4 bytes are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            place += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method in (0, 8):
            header = read(local, 30)
            if header[:4] != b"PK\3\4":
                raise ValueError(f"no member where the directory has {name}")
            skip = struct.unpack_from("<HH", header, 26)
            found[name] = (local + 30 + sum(skip), packed if method else plain, method == 8)
    return found


# -- Spark ------------------------------------------------------------------------------------------------------------


def revisits(df: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """Rows (id, digest, rep) of the pages that revisit another: of pages with equal payloads the largest id is the response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    narrow = df.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest")).where(F.col("n") >= min_bytes)
    narrow = staged(narrow.select("id", F.unhex("digest").alias("digest")), "digests")
    reps = narrow.groupBy("digest").agg(F.max("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1 and rep is not null")
    return narrow.join(reps.select("digest", "rep"), "digest").where(~F.col("id").eqNullSafe(F.col("rep"))).select("id", "digest", "rep").distinct()


def _record_id(column: str) -> Column:
    """The record id of a page: its id as text, percent-encoded; without a colon after ``page`` for null."""
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(F.col(column).cast("string"))), F.lit("")), F.lit(">"))


def page_of(column: str, kind: str) -> Column:
    """The page id, of type ``kind``, that a record id names; null if it names none."""
    return F.when(F.startswith(F.col(column), F.lit("<urn:page:")), F.try_url_decode(F.regexp_extract(column, "^<urn:page:(.*)>$", 1)).try_cast(kind))


def write_archives(df: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """Writes a record per row and returns the manifest: rows (path, records, bytes), one per archive.

    An archive's name is new for each attempt of a task, and the manifest, written by Spark, names those of the attempts
    that counted: what a lost executor or a second attempt left behind is in no manifest and so never read.  The pages that
    revisit others are written to a table first: the pages themselves are dealt anew only if it is too large to broadcast.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(html_col), F.lit("")).cast("binary"), 256))
    again = staged(revisits(df, id_col, html_col, min_bytes), "revisits")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), digest.alias("d"))
    rows = rows.join(again.select(F.col("id").alias("id_"), F.col("digest").alias("d_"), "rep"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("d") == F.col("d_")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, local = filesystem(path)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        index, at = [], 0

        def each():
            yield first
            yield from batches

        with fs.open_output_stream(local) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as out:
                for batch in each():
                    for name, url, html, rep in zip(*(batch.column(i).to_pylist() for i in range(4))):
                        packed = gzip.compress(record(name, url, (html or "").encode(), rep), level, mtime=0)
                        out.write(packed)
                        place = {"url": url or "", "filename": DATA.rpartition("/")[2], "offset": str(at), "length": str(len(packed))}
                        index.append(f"{name} 19700101000000 {json.dumps(place)}\n")
                        at += len(packed)
            package.writestr(INDEX, "".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], names=["path", "records", "bytes"])

    rows = rows.select(_record_id("id").alias("name"), "url", "html", F.when(F.col("rep").isNotNull(), _record_id("rep")).alias("rep"))
    return staged(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


#: Bytes of neighbouring records that are read at once, and that a task reads at least where there are many tasks anyway.
RANGE_BYTES, TASK_BYTES = 4 << 20, 256 << 20


def _places(f, found: dict[str, tuple[int, int, bool]]) -> dict[str, list[tuple[int, int]]]:
    """Offset and length of the records of each WARC member, as the archive's indexes tell; none for one that no index names."""
    warcs = {name: [] for name, (_, _, packed) in found.items() if name.startswith("archive/") and not packed}
    only = next(iter(warcs)) if len(warcs) == 1 else None
    for name, (at, size, packed) in found.items():
        if not (name.startswith("indexes/") and ".cdx" in name):
            continue
        raw = f.read_at(size, at)
        raw = zlib.decompress(raw, -15) if packed else raw
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        for line in raw.splitlines():
            brace = line.find(b"{")
            if brace < 0:
                continue
            place = json.loads(line[brace:])
            member = f"archive/{place['filename'].removeprefix('archive/')}" if "filename" in place else only
            if member in warcs and "offset" in place and "length" in place:
                warcs[member].append((int(place["offset"]), int(place["length"])))
    return {name: sorted(set(places)) for name, places in warcs.items()}


def _walk(f, start: int, length: int) -> Iterator[bytes]:
    """All records of a WARC member without an index, one after the other, in bounded memory but for the longest record."""
    end, at, packed = start + length, start, None
    raw = b""
    while at < end or raw:
        if packed is None:
            raw = f.read_at(min(2, length), start)
            packed, raw = raw == b"\x1f\x8b", b""
        if packed:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if not raw:
                    if at >= end:
                        raise ValueError("a packed record is cut off")
                    raw = f.read_at(min(1 << 20, end - at), at)
                    at += len(raw)
                parts.append(unpack.decompress(raw))
                raw = unpack.unused_data
            yield b"".join(parts)
            continue
        while b"\r\n\r\n" not in raw and at < end:
            raw += (more := f.read_at(min(1 << 16, end - at), at))
            at += len(more)
        head, found, _ = raw.partition(b"\r\n\r\n")
        if not found:
            if raw.strip():
                raise ValueError("no WARC record here")
            return
        need = len(head) + 8 + int(_fields(head.strip().split(b"\r\n")[1:])["content-length"])
        parts = [raw]
        have = len(raw)
        while have < need and at < end:
            parts.append(f.read_at(min(need - have, end - at), at))
            at += len(parts[-1])
            have += len(parts[-1])
        raw = b"".join(parts)
        yield raw[:need].lstrip(b"\r\n")
        raw = raw[need:]


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows (record_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the archives
    whose place stands in column ``path``; ``refers_to`` is a record id.

    A first pass reads each archive's directories and indexes only and cuts its records into ranges of about 4 MB; ranges
    are dealt evenly to tasks, as many as there are ranges up to the number of shuffle partitions, and more where a task
    would read over 256 MB; they are read and parsed there.  Records that no index names are left out if the index names
    others of their member, as an index may leave out requests; a member that no index names at all is read through by one task.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = filesystem(path)
                cut: list[tuple[int, list[int]]] = []
                with fs.open_input_file(local) as f:
                    found = all_members(lambda offset, length: f.read_at(length, offset), f.size())
                    for name, places in _places(f, found).items():
                        start, size, _ = found[name]
                        if not places:
                            cut.append((start, [-size]))  # read through, record by record
                        upto, held = -1, 0
                        for offset, length in places:
                            if offset != upto or held + length > RANGE_BYTES:
                                cut.append((start + offset, []))
                                held = 0
                            cut[-1][1].append(length)
                            upto, held = offset + length, held + length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(cut), pa.string()), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.list_(pa.int64())), pa.array([abs(sum(c[1])) for c in cut], pa.int64())],
                    names=["path", "start", "sizes", "bytes"],
                )

    names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for path, start, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, local = filesystem(path)
                with fs.open_input_file(local) as f:
                    if sizes[0] < 0:
                        yield from (table([parse_record(x)]) for x in _walk(f, start, -sizes[0]))
                        continue
                    raw = f.read_at(sum(sizes), start)
                found, at = [], 0
                for size in sizes:
                    one = raw[at : at + size]
                    found.append(parse_record(gzip.decompress(one) if one[:2] == b"\x1f\x8b" else one))
                    at += size
                yield table(found)

    spark = manifest.sparkSession
    planned = staged(manifest.select("path").mapInArrow(ranges, "path string, start long, sizes array<long>, bytes long"), "ranges")
    n, size = planned.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))))
    schema = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    return planned.select("path", "start", "sizes").repartition(tasks).mapInArrow(read, schema)


def round_trip(df: DataFrame, min_bytes: int = 0, payloads: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all rows of ``df`` in a new folder of the shared one, and reads them back as rows (page_id, url, payload_bytes,
    payload_digest, record_type, refers_to[, payload]).

    A null html is an empty payload; payloads of fewer than ``min_bytes`` bytes are always responses; rows that agree in id
    and payload are records of one kind; a null id is a record of its own name and refers to the payload's largest id; ids
    may have any type that is cast to text and back; a null url reads back as an empty one; an empty table makes no archive
    and gives no rows; further columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    records = read_archives(write_archives(df, stage_path(df.sparkSession, "archives"), min_bytes, id_col, url_col, html_col), payloads)
    return records.select(
        page_of("record_id", kind).alias(id_col), F.col("url").alias(url_col), "payload_bytes", "payload_digest", "record_type", page_of("refers_to", kind).alias("refers_to"), *["payload"] * payloads
    )

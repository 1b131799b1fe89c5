"""WARC archives: a writer of gzip members and a splittable reader.

Each record is a gzip member of its own. The reader deals byte ranges of the files to tasks; a task looks for the gzip
magic in its range, decodes the start of each candidate to see whether a WARC header follows, and owns the records
that start inside the range, reading past its end to finish the last one. Nothing but the file's size is needed in
advance, so one large file is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_limits, scratch, written

#: Bytes of a reading task's range.
SPLIT = 8 << 20
#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes given to the decoder at first; most records end within.
PEEK = 16 << 10
#: Payloads of several pages up to this number are broadcast (about 60 bytes each); more are joined in SALT parts each.
BROADCAST_OWNERS, SALT = 500_000, 32
MAGIC = b"\x1f\x8b\x08"
_HEADER = b"WARC/1."

RECORD = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary, file string, position long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(uri: str):
    """(file system, path) for a folder or file that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int) -> str:
    """A stable record id, so that a revisit can name its response before that is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int, url: str | None, payload: bytes, payload_digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit carries no payload but names its response, length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    if refers_to is None:
        body += payload
    target = re.sub(r"[\r\n]+", " ", url) if url else ""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if url is not None else []), f"X-Page-ID: {page_id}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def decode_record(data: bytes) -> dict:
    """The fields of any WARC record. Header names count in any case; what a record lacks is null.

    The payload is what follows the HTTP header in records of type application/http, else the whole block. Digest and
    length are taken from it; a revisit has none, so its own header gives both.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    block = rest[: number("content-length") or 0]
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    kind = fields.get("warc-type")
    whole = kind != "revisit"
    named = fields.get("warc-payload-digest")
    return {
        "page_id": number("x-page-id"), "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "payload_digest": base32_sha1(payload) if whole else named and named.removeprefix("sha1:"),
        "refers_to": None if whole else number("x-refers-to-page"), "payload_bytes": len(payload) if whole else number("x-payload-length"), "payload": payload if whole else None,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file a task, under a name of its own: a task that is run again leaves no half-written file in the list."""
        store, base = _files(folder)
        path, out, records = posixpath.join(base, f"{uuid.uuid4().hex}.warc.gz"), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                payload = (row["html"] or "").encode()
                out.write(encode_record(row["page_id"], row["url"], payload, row["payload_digest"], row["payload_bytes"], row["refers_to"]))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, posixpath.basename(path))]), pa.array([size]), pa.array([records])], ["file", "bytes", "records"])

    return run


def planned_records(pages: DataFrame, least_bytes: int = 0, broadcast_owners: int = BROADCAST_OWNERS) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes and refers_to of each page's record.

    Of pages with equal payloads of at least least_bytes bytes the one with the largest page_id is the response. A null html is an empty payload.
    Only digests of several pages are joined; a digest that many pages share is one row on the other side of that join.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # The hexadecimal digest is regrouped by five bits: two digits are eight bits, five bytes eight letters.
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    owners = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least_bytes)
    owners = owners.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("many")).filter("many > 1").select("sha", "owner")
    # Owners are few where most payloads are unique: then no page is moved. Else owners and rows are salted, since one
    # payload may be shared by any number of pages.
    owners = written(owners, "owners")
    if owners.count() <= broadcast_owners:
        rows = rows.join(F.broadcast(owners), "sha", "left")
    else:
        owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALT))).join(owners, ["sha", "salt"], "left").drop("salt")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("owner"))
    return rows.select("page_id", "url", "html", _base32(F.col("sha")).alias("payload_digest"), "payload_bytes", F.when(revisit, F.col("owner")).alias("refers_to"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(twenty: Column) -> Column:
    """Base32 of 20 bytes: each group of five bytes as a number in base 32 (eight digits)."""
    groups = [F.conv(F.substring(F.hex(twenty), 10 * k + 1, 10), 16, 32) for k in range(4)]
    digits = F.concat(*(F.lpad(g, 8, "0") for g in groups))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", _LETTERS)


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one record for each page with a page_id into archives under `folder`; returns (file, bytes, records).

    The list names only files of tasks that ended well. A repeated page_id gets a record for each row; the largest
    id's rows are all responses. Pages without page_id are left out. An empty table writes nothing.
    """
    arrow_limits(pages.sparkSession)
    rows = planned_records(pages.filter("page_id IS NOT NULL"), least_bytes)
    return written(rows.mapInArrow(_writer(folder), "file string, bytes long, records long"), "warc-list")


def _member(read, start: int, size: int, first: bytes) -> tuple[bytes, int] | None:
    """The member that begins at `start` and where it ends, or None if no whole one begins there. `first` holds the bytes that are there already."""
    unpack = zlib.decompressobj(31)
    try:
        head = unpack.decompress(first, 16)
        at, step = start + len(first), PEEK
        while len(head) < len(_HEADER) and not unpack.eof and at < size:
            more = read(at, min(step, size - at))
            at += len(more)
            head += unpack.decompress(unpack.unconsumed_tail + more, 16)
        if not head.startswith(_HEADER):
            return None
        parts = [head, unpack.decompress(unpack.unconsumed_tail)]
        while not unpack.eof and at < size:
            more = read(at, min(step, size - at))
            step = min(2 * step, CHUNK)
            if not more:
                break
            at += len(more)
            parts.append(unpack.decompress(more))
    except zlib.error:
        return None
    return (b"".join(parts), at - len(unpack.unused_data)) if unpack.eof else None


def plain_records_in(read, size: int, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """As records_in, for archives that are not compressed. A record must have a type and a length, and what follows it
    must be another record or the file's end, so a version line within a payload is passed over."""
    at = first
    while at < last:
        data = read(at, min(CHUNK, size - at))
        k = data.find(_HEADER)
        if k < 0 or at + k >= last:
            if k >= 0 or at + len(data) >= size:
                return
            at += max(len(data) - len(_HEADER) + 1, 1)
            continue
        at += k
        head = read(at, min(PEEK, size - at)).partition(b"\r\n\r\n")[0]
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", head.replace(b"\r\n", b"\n"))
        end = at + len(head) + 4 + int(length[1]) if length and re.search(rb"(?im)^warc-type:", head) else size + 1
        tail = read(end, min(4 + len(_HEADER), size - end)) if end <= size else b"?"
        if tail in (b"", b"\r\n\r\n") or tail == b"\r\n\r\n" + _HEADER:
            yield at, read(at, end - at)
            at = end
        else:
            at += 1


def records_in(read, size: int, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(position, record) of the records that start in [first, last); read(position, length) gives bytes of the file.

    Bytes that only look like a member's start are passed over: their contents don't decode to a WARC header.
    """
    at = first
    while at < last:
        data = read(at, min(CHUNK, size - at))
        if not data:
            return
        k = 0
        while True:
            k = data.find(MAGIC, k)
            if k < 0 or at + k >= last:
                break
            found = _member(read, at + k, size, data[k : k + PEEK])
            if found is None:
                k += 1
                continue
            yield at + k, found[0]
            # What lies within a record is no other's start.
            k = found[1] - at
            if k >= len(data):
                break
        # A magic may lie across the edge of two reads.
        at = max(at + k, at + max(len(data) - len(MAGIC) + 1, 1) if at + len(data) < size else at + len(data))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])
    for batch in batches:
        for part in batch.to_pylist():
            store, path = _files(part["file"])
            with store.open_input_file(path) as f:
                held, many = [], 0
                packed = f.read_at(len(MAGIC), 0) == MAGIC
                for position, data in (records_in if packed else plain_records_in)(lambda at, n: f.read_at(n, at), part["bytes"], part["first"], part["last"]):  # noqa: B023
                    held.append(decode_record(data) | {"file": part["file"], "position": position})
                    many += len(data)
                    if many > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, many = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)


def read_warc(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the files (file, bytes): page_id, record_id, record_type, target_uri, payload_digest, refers_to,
    payload_bytes, payload (null for revisits), file and position. Digest and length of a response are taken from the
    payload that was read. Archives of other makers are read as well, compressed by record or not: a field that a record
    lacks is null, and a record that is cut off or not a record is left out. An empty list gives no rows."""
    first = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("first")
    parts = files.filter("bytes > 0").select("file", "bytes", first).withColumn("last", F.least(F.col("first") + split, "bytes"))
    # One range a task, near enough: ranges are dealt out evenly.
    tasks = max(1, int(parts.count()))
    return parts.repartition(tasks).mapInArrow(_reader, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, split: int = SPLIT) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    files = write_warc(pages, scratch(spark, "warc"), least_bytes)
    return read_warc(spark, files, split)


def oracle_sql() -> str:
    """Digests in base 32 by shifting five bits at a time out of 40-bit groups."""
    letters = " || ".join(f"substring('{_LETTERS}', 1 + CAST((g >> {5 * k}) & 31 AS INT), 1)" for k in range(7, -1, -1))
    groups = " || ".join(f"b32(CAST('0x' || substring(hexed, {10 * k + 1}, 10) AS BIGINT))" for k in range(4))
    for k in range(4):
        groups = groups.replace(f"b32(CAST('0x' || substring(hexed, {10 * k + 1}, 10) AS BIGINT))", "(" + letters.replace("g >>", f"CAST('0x' || substring(hexed, {10 * k + 1}, 10) AS BIGINT) >>") + ")")
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages WHERE page_id IS NOT NULL),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hexed FROM p),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY hexed) AS owner FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {groups} AS payload_digest,
               CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < owner THEN owner END AS refers_to
        FROM o"""

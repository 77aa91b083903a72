"""WARC archives: a writer and a splittable reader (operator 9).

Every record is a gzip member of its own, as the format recommends. The writer runs in the tasks of
a table of records; a task writes one archive under a name of its own attempt and renames it when
it is complete, so a lost executor leaves no half archive under a listed name, and the list of
archives (path, size) comes from the tasks that succeeded. Files go through ``pyarrow.fs``, hence to
any shared store that an executor can reach by URI.

The reader cuts archives into byte ranges. A task scans its range for gzip magic, takes a
position as a member's start only if the bytes there inflate to a WARC version line, and owns the
records that start inside its range; it reads on beyond the range's end to finish the last one.
Compressed data that happens to contain the magic is refused by that check. A record is held in
memory while it is read, an archive never is.

Payloads of at least ``LEAST_BYTES`` that are equal to that of a smaller page_id are written as
revisit records without payload, with the digest and a reference; the reader gives them the
digest and length of the record they refer to. Null html is an empty payload. Rows with a null
page_id are written as responses, read back with a null page_id and never referred to; rows that
repeat a page_id are records of their own, and those with the smallest one of a payload are all
responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import new_folder, stored, text_of

LEAST_BYTES = 100
#: bytes of an archive that one read task scans
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16

RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long")


def _filesystem(uri: str):
    """File system and path of a URI, or of a plain local path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- writing

def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record_bytes(page_id, url, html: bytes, sha256: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit (``refers_to`` not null) has no payload."""
    digest = base64.b32encode(bytes.fromhex(sha256)).decode().rstrip("=")
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n%s" % (len(html), html))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(html)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(" " if c in "\r\n" else c for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write_archives(folder: str):
    def write(batches):
        from pyspark import TaskContext

        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = n = 0
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(name + ".open", compression=None)
                data = record_bytes(row["page_id"], row["url"], row["html"], row["sha256"], row["refers_to"])
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            fs.move(name + ".open", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return write


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (UTF-8 bytes), sha256, refers_to (null for a response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.encode(text_of("html"), "UTF-8").alias("html"))
    rows = rows.withColumn("sha256", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= F.lit(least_bytes)
    # repeats are found on digests alone and written; the pages then meet the few repeated digests,
    # which the planner broadcasts if their written size allows, so that no page is shuffled
    first = stored(rows.where(long_enough).groupBy("sha256").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("sha256", "first"), "repeats")
    joined = rows.join(first, "sha256", "left")
    return joined.select("page_id", "url", "html", "sha256",
                         F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``pages`` to archives under ``folder``; returns path, bytes, records."""
    records = with_revisits(pages)
    return stored(records.mapInArrow(_write_archives(folder), "path string, bytes long, records long"), "archives")


# ---------------------------------------------------------------- reading

class _Window:
    """Bytes of a file from a position on, read forward in steps."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()
        file.seek(at)

    def fill(self, upto: int) -> bool:
        """Whether the byte before position ``upto`` could be read."""
        while self.base + len(self.data) < upto:
            more = self.file.read(STEP)
            if not more:
                return False
            self.data += more
        return True

    def part(self, at: int) -> bytes:
        return bytes(self.data[at - self.base:at - self.base + STEP])

    def drop(self, before: int) -> None:
        if before > self.base + STEP:
            del self.data[:before - self.base]
            self.base = before


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and its end, if it inflates to a WARC record."""
    unpack = zlib.decompressobj(31)
    parts: list[bytes] = []
    checked = False
    position = at
    while not unpack.eof:
        if not window.fill(position + 1):
            return None
        chunk = window.part(position)
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        position += len(chunk)
        if not checked:
            start = b"".join(parts)[:7]
            if len(start) == 7 or unpack.eof:
                if start != b"WARC/1.":
                    return None
                checked = True
    return b"".join(parts), position - len(unpack.unused_data)


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose member starts in [start, end) of an open archive."""
    window = _Window(file, start)
    at = start
    while at < end:
        window.drop(at)
        if not window.fill(at + len(MAGIC)):
            return
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            at = window.base + len(window.data) - len(MAGIC) + 1     # the magic may be cut here
            if not window.fill(at + len(MAGIC)):
                return
            continue
        at = window.base + found
        if at >= end:
            return
        got = _member(window, at)
        if got is None:
            at += 1
            continue
        record, at = got
        yield record


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[:int(fields.get("content-length", 0))]


def payload(block: bytes) -> bytes:
    """The body of the HTTP message in a response block."""
    return block.partition(b"\r\n\r\n")[2]


def _read_row(record: bytes) -> tuple:
    fields, block = parsed(record)
    page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
    url = fields.get("warc-target-uri")
    if fields["warc-type"] == "revisit":
        name = fields["warc-payload-digest"].removeprefix("sha256:")
        digest = base64.b32decode(name + "=" * (-len(name) % 8)).hex()
        return page_id, url, int(fields["x-payload-length"]), digest, "revisit", int(fields["x-refers-to-page-id"])
    body = payload(block)
    return page_id, url, len(body), hashlib.sha256(body).hexdigest(), "response", None


def _read_ranges(folder: str):
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string())
                        for name, kind in (c.split() for c in RECORD.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def read(batches):
        fs, _ = _filesystem(folder)
        for given in batches:
            for part in given.to_pylist():
                with fs.open_input_file(part["path"]) as file:
                    rows = []
                    for record in records_in(file, part["start"], part["end"]):
                        rows.append(_read_row(record))
                        if len(rows) == 2_000:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)

    return read


#: read tasks at most; beyond it a task reads several ranges
MOST_TASKS = 100_000


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record (see ``RECORD``) of the archives listed in ``archives`` (path, bytes)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(range_bytes))).cast("long")
    ranges = (archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
              .select("path", (F.col("k") * range_bytes).alias("start"),
                      F.least(F.col("bytes"), (F.col("k") + 1) * range_bytes).alias("end")))
    # ranges are few and small rows; without a number of partitions they would be merged into one task
    tasks = min(2 * ranges.count() + 1, MOST_TASKS)
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read_ranges(folder), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url as read back from archives."""
    folder = new_folder(pages.sparkSession, "warc")
    archives = write_archives(pages, folder)
    return read_archives(archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100
                     THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM f
"""

"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer's tasks put each record into a gzip member of its own, in files named anew on every attempt;
only the rows of tasks that ended well name their files, so a lost executor leaves nothing that is read.
The reader deals byte ranges of the archives to tasks. A record belongs to the range where it starts. A
record must parse, hold as many bytes as it says, end as the format asks and agree with its digest;
after a failed check, and at the start of a range, the search goes on from the next byte for a gzip
member or a version line that passes. Bytes inside no record are the quarantined gaps. Digests are checked in
any of the algorithms below, in hex or base32; one of another algorithm is not checked. The query compares the
records that it read with those that were written and fails, naming the first gaps, if any is missing.

The files are opened by the tasks through pyarrow's file systems, under the folder given (the session's
shared folder in the query). A member is inflated whole, so a record must fit a task; heads may have any length.
Defined cases: a null html is an empty payload, a null url an empty header; a
null page_id writes an id that reads as null, and ids of any type are percent-encoded; rows that repeat the smallest page_id of a payload are all responses;
a length that is no number of ASCII digits fails its record; a revisit without the length or digest of its payload has
nulls there; empty tables write no file and read as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.plans.scratch import materialize, scratch_path

#: payloads shorter than this are never revisits
REVISIT_BYTES = 100
FILE_BYTES, RANGE_BYTES, CHUNK = 64 << 20, 8 << 20, 1 << 16

FILES = T.StructType().add("path", T.StringType()).add("size", T.LongType()).add("records", T.LongType())
RECORDS = (
    T.StructType()
    .add("path", T.StringType())
    .add("start", T.LongType())
    .add("size", T.LongType())
    .add("record_type", T.StringType())
    .add("record_id", T.StringType())
    .add("url", T.StringType())
    .add("refers_to", T.StringType())
    .add("payload_bytes", T.LongType())
    .add("payload_digest", T.StringType())
    .add("payload", T.BinaryType())
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ID = re.compile(r"^<urn:page:(.*)>$")
_NONE = "<urn:page-none>"
_DIGITS = re.compile(r"[0-9]{1,18}")
_HTTP_LENGTH = re.compile(rb"(?i)(?:^|\n)content-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r|$)")
#: fixed values: digest algorithms by their names in records
ALGORITHMS = {"sha256", "sha1", "sha512", "sha384", "md5"}
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a Hadoop-style path."""
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:", "", path)
    return fs.FileSystem.from_uri(path)


def page_uri(page_id) -> str:
    return _NONE if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(kind: str, page_id, url: str | None, body: bytes | None, digest: str, size: int, refers_to=None) -> bytes:
    """One record; a revisit (``body`` None) has the HTTP head of its payload only."""
    block = _HTTP % size + (body or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: page_id, url, html, digest, first."""
        store, base = open_store(folder)
        out, path, size, count = None, "", 0, 0

        def done():
            return pa.RecordBatch.from_pylist([{"path": path, "size": size, "records": count}], schema=_FILES)

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder.rstrip('/')}/{name}", 0, 0
                    out = store.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                body = (html or "").encode()
                if first is None or first == page_id:
                    data = record("response", page_id, url, body, digest, len(body))
                else:
                    data = record("revisit", page_id, url, None, digest, len(body), first)
                data = member(data)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    return write


_FILES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
_RECORDS = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("size", pa.int64())]
    + [(c, pa.string()) for c in ("record_type", "record_id", "url", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the files as (path, size, records)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    shared = pages.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.sha2("html", 256).alias("digest"))
    firsts = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(materialize(firsts, "firsts"), "digest", "left").select("page_id", "url", "html", "digest", "first")
    return materialize(joined.mapInArrow(_writer(folder), FILES), "archives")


class Reader:
    """Random access to one archive with a small window of bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, 16 * CHUNK))
        return self.held[start - self.at : start - self.at + n]

    def find(self, start: int, end: int) -> int:
        """Next place before ``end`` where a record may start, else -1."""
        while start < end:
            data = self.bytes(start, min(CHUNK, end - start) + 16)
            places = [p for p in (data.find(b"\x1f\x8b\x08"), data.find(b"WARC/1.")) if p >= 0]
            if places and start + min(places) < end:
                return start + min(places)
            start += CHUNK
        return -1


def digest_fails(given: str | None, data: bytes) -> bool:
    """Whether a digest (algorithm:value) says that ``data`` is damaged."""
    name, colon, value = (given or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ALGORITHMS:
        return False
    found = hashlib.new(name, data)
    if len(value) == 2 * found.digest_size:
        return value.lower() != found.hexdigest()
    return value.upper().rstrip("=") != base64.b32encode(found.digest()).decode().rstrip("=")


def parse(data: bytes) -> dict | None:
    """Fields of a whole record, or None when a check fails."""
    if not _VERSION.match(data):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode(errors="replace").strip().lower()] = value.decode(errors="replace").strip()
    length = fields.get("content-length", "")
    block = data[end + 4 :]
    if not _DIGITS.fullmatch(length) or len(block) != int(length) + 4 or not block.endswith(b"\r\n\r\n"):
        return None
    block = block[:-4]
    if digest_fails(fields.get("warc-block-digest"), block):
        return None
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    kind = fields.get("warc-type", "")
    given = fields.get("warc-payload-digest")
    if kind == "revisit":
        said = fields.get("x-payload-length")
        if said is None and (found := _HTTP_LENGTH.search(block)):
            said = found[1].decode()
        if said is not None and not _DIGITS.fullmatch(said):
            return None
        size, own = None if said is None else int(said), given and given.removeprefix("sha256:")
    else:
        if digest_fails(given, payload):
            return None
        size, own = len(payload), hashlib.sha256(payload).hexdigest()

    def page(name: str) -> str | None:
        said = fields.get(name)
        found = _ID.match(said or "")
        return unquote(found[1]) if found else None if said == _NONE else said

    return {
        "record_type": kind, "record_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": page("warc-refers-to"),
        "payload_bytes": size, "payload_digest": own, "payload": payload,
    }


def record_at(reader: Reader, start: int) -> tuple[int, dict] | None:
    """(bytes taken, fields) of the record that starts at ``start``, or None when a check fails."""
    if reader.bytes(start, 3) == b"\x1f\x8b\x08":
        z, parts, at = zlib.decompressobj(31), [], start
        try:
            while not z.eof and at < reader.size:
                data = reader.bytes(at, CHUNK)
                parts.append(z.decompress(data))
                at += len(data)
        except zlib.error:
            return None
        if not z.eof or (fields := parse(b"".join(parts))) is None:
            return None
        return at - len(z.unused_data) - start, fields
    head = reader.bytes(start, CHUNK)
    if not _VERSION.match(head):
        return None
    end, n = head.find(b"\r\n\r\n"), CHUNK
    while end < 0 and start + n < reader.size and all(b":" in line for line in head.split(b"\n")[1:-1]):
        n *= 2  # so far it reads like a head
        head = reader.bytes(start, n)
        end = head.find(b"\r\n\r\n")
    length = re.search(rb"(?i)\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", head[: end + 2]) if end >= 0 else None
    if not length:
        return None
    size = end + 8 + int(length[1])
    if start + size > reader.size or (fields := parse(reader.bytes(start, size))) is None:
        return None
    return size, fields


def salvage(reader: Reader, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(start, size, fields) of each good record that starts in [start, end)."""
    at = start
    while 0 <= at < end:
        found = record_at(reader, at)
        if found:
            yield at, found[0], found[1]
            at += found[0]
        else:
            at = reader.find(at + 1, end)


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: path, size, start, end."""
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = open_store(path)
                with store.open_input_file(at) as file:
                    rows, held = [], 0
                    for where, taken, fields in salvage(Reader(file, size), start, end):
                        held += len(fields["payload"])
                        rows.append({"path": path, "start": where, "size": taken} | fields | ({} if with_payload else {"payload": None}))
                        if held >= FILE_BYTES // 4:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return read


def read_archives(files: DataFrame, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Good records of ``files`` (path, size). A record inside the bytes of an earlier one is part of its payload and left out."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.where("size > 0").select("path", "size", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("size")))
    found = ranges.repartition("path", "start").mapInArrow(_reader(with_payload), RECORDS)
    before = Window.partitionBy("path").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("start") + F.col("size")).over(before)
    return found.withColumn("_reached", reached).where("_reached is null or start >= _reached").drop("_reached")


def gaps(files: DataFrame, records: DataFrame) -> DataFrame:
    """Quarantined bytes: (path, start, size) of every stretch of a file inside no good record."""
    edges = records.select("path", "start", (F.col("start") + F.col("size")).alias("end")).unionByName(
        files.select("path", F.col("size").alias("start"), F.col("size").alias("end"))
    )
    before = F.coalesce(F.lag("end").over(Window.partitionBy("path").orderBy("start", "end")), F.lit(0))
    return edges.withColumn("_from", before).where("start > _from").select(
        "path", F.col("_from").alias("start"), (F.col("start") - F.col("_from")).alias("size")
    )


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives below ``folder``, through Spark's own file listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(folder)
    return found.select("path", F.col("length").alias("size"))


def all_read(files: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` of just written ``files``, or an error that names gaps if some are missing."""
    written, found = files.agg(F.sum("records")).first()[0] or 0, records.count()
    if written != found:
        first = [tuple(r) for r in gaps(files, records).orderBy("path", "start").limit(5).collect()]
        raise RuntimeError(f"{written} records written, {found} read; first gaps (path, start, size): {first}")
    return records


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_archives(pages, scratch_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    read = all_read(files, materialize(read_archives(files).drop("payload"), "records"))
    return read.select(
        F.col("record_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind).alias("refers_to")
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

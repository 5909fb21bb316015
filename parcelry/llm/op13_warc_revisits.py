"""Web archives (WARC 1.1, a gzip member a record): writing, reading, and revisit resolution.

Archives are read into an index of headers; headers are shuffled by payload digest, each digest gets one original
response, other responses and older revisit records of the digest are joined to it, and the archives are written anew:
originals whole, the others as revisit records without payload, all with fresh headers. Payloads are never grouped; they
move, compressed, only where the list of revisits is too long to be sent to all tasks.

Spark's text writer puts each finished archive, one row of bytes, into a file of its own, so files are committed as any
of Spark's, on any file system, and the archives of lost or repeated tasks are not seen. A file ends with a zero byte,
which readers of gzip skip as padding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, read, shared_dir

#: Uncompressed bytes after which an archive is closed, and the level of compression.
ARCHIVE_BYTES, LEVEL = 64 << 20, 4
#: Payloads below this stay responses.
MIN_BYTES = 0
#: Revisits up to this many are sent to all tasks (some 200 bytes each); beyond, archives are shuffled to them.
SENT = 20_000
#: Date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format: version, the profile of revisits with equal payloads, kinds that hold a payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOADS = ("response", "resource")

INDEX = "file string, place int, kind string, record_id string, uri string, date string, page_id long, digest string, payload_bytes long, refers_to string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def fresh_id(old: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, old)}>"


def record(fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    """A record: its fields, those that are None left out, and its block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of an archive, plain or gzipped, by a member a record or as a whole. Blocks go
    by their length alone; an archive that breaks off raises ValueError."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("an archive breaks off inside a record")
        yield fields, block


def parted(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header of a block, if it has one, and its payload."""
    if "application/http" in fields.get("content-type", ""):
        head, mark, payload = block.partition(b"\r\n\r\n")
        return head + mark, payload
    return b"", block


def _archives(found: Iterable[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Closed archives, one a batch."""
    members: list[bytes] = []
    held = 0
    for r in found:
        members.append(gzip.compress(r, LEVEL, mtime=0))
        held += len(r)
        if held >= most:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])
            members, held = [], 0
    if members:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])


def _save(archives: DataFrame, path: str) -> None:
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A response record for each row: the html in UTF-8 as payload (null: empty), the id as field Page-ID (null: none)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for page_id, url, html in zip(b.column(0), b.column(1), b.column(2).cast(pa.large_binary()), strict=True):
                payload, n = html.as_py() or b"", n + 1
                page_id, url, own = page_id.as_py(), url.as_py(), digest_of(payload)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                yield record(
                    [("WARC-Type", "response"), ("WARC-Record-ID", fresh_id(f"{task}/{n}/{page_id}/{own}")), ("WARC-Date", DATE), ("WARC-Target-URI", f"urn:page:{page_id}" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")),
                     ("WARC-Payload-Digest", f"sha1:{own}"), ("Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")], head + payload,
                )

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    _save(rows.mapInArrow(lambda batches: _archives(made(batches), archive_bytes), "archive binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row of headers a record of the archives in a folder, each archive under 2 GB. digest and payload_bytes are
    those of the payload that is there; of revisits, the digest that they name and no size."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for place, (f, block) in enumerate(records(content.as_py() or b"")):
                    kind, named = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:").upper() or None
                    payload = parted(f, block)[1] if kind in PAYLOADS else None
                    own, size = (named, None) if payload is None else (digest_of(payload), len(payload))
                    page = f.get("page-id", "")
                    rows.append((file.as_py(), place, kind, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), int(page) if page.lstrip("-").isdigit() else None, own, size, f.get("warc-refers-to")))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return _files(spark, path).mapInArrow(seen, INDEX)


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(file, place, to_id, to_uri, to_date): records that are to be revisits of another one. Of responses with equal
    payloads of min_bytes and more, the one of largest page_id (nulls last, ties by date and record id) is the original;
    revisits that name its digest go to it as well; those whose original isn't there are not listed."""
    rows = headers.filter(F.col("kind").isin(*PAYLOADS) & (F.col("payload_bytes") >= min_bytes) | (F.col("kind") == "revisit"))
    # sizes, partial before the shuffle; a digest of one record needs no join
    original = F.max(F.when(F.col("kind") != "revisit", F.struct("page_id", "date", "record_id", "uri", "file", "place")))
    chosen = rows.groupBy("digest").agg(F.count("*").alias("n"), original.alias("to")).filter("n > 1 and to is not null")
    found = lookup(rows.select("file", "place", "digest"), cut(chosen), ["digest"], size="n", how="inner")
    return found.filter("file != to.file or place != to.place").select("file", "place", F.col("to.record_id").alias("to_id"), F.col("to.uri").alias("to_uri"), F.col("to.date").alias("to_date"))


def _renewed(fields: dict[str, str], block: bytes, to: dict | None) -> bytes:
    """The record with fresh headers; as a revisit of `to`, if that is given."""
    kind = fields.get("warc-type")
    head, payload = parted(fields, block)
    linked = lambda name: fresh_id(fields[name]) if name in fields else None
    own = digest_of(payload) if kind in PAYLOADS else None
    named = f"sha1:{own}" if own else fields.get("warc-payload-digest")
    if to is None:
        refers = [("WARC-Refers-To", fields.get("warc-refers-to")), ("WARC-Refers-To-Target-URI", fields.get("warc-refers-to-target-uri")), ("WARC-Refers-To-Date", fields.get("warc-refers-to-date")), ("WARC-Profile", fields.get("warc-profile"))]
    else:
        kind, block = "revisit", head
        refers = [("WARC-Refers-To", fresh_id(to["to_id"])), ("WARC-Refers-To-Target-URI", to["to_uri"]), ("WARC-Refers-To-Date", to["to_date"]), ("WARC-Profile", PROFILE)]
    return record(
        [("WARC-Type", kind), ("WARC-Record-ID", linked("warc-record-id")), ("WARC-Date", fields.get("warc-date")), ("WARC-Target-URI", fields.get("warc-target-uri")), ("WARC-Payload-Digest", named), *refers,
         ("WARC-Concurrent-To", linked("warc-concurrent-to")), ("WARC-Warcinfo-ID", linked("warc-warcinfo-id")), ("Page-ID", fields.get("page-id")), ("Content-Type", fields.get("content-type"))], block,
    )


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives of folder source to folder target, which must not be there yet, every record in its place with
    fresh headers, and repeated payloads as revisits. Record ids are made from the old ones, so a repeated run writes
    the same."""
    changes = cut(revisits(cut(index(spark, source)), min_bytes))
    n = changes.count()
    # of one archive, so at most as many as that has records
    lists = changes.groupBy("file").agg(F.collect_list(F.struct("place", "to_id", "to_uri", "to_date")).alias("changes"))
    files = _files(spark, source)
    if not n:
        files = files.withColumn("changes", F.lit(None).cast(lists.schema["changes"].dataType))
    else:
        files = files.join(F.broadcast(lists) if n <= SENT else lists, "file", "left")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for content, to in zip(b.column(0), b.column(1), strict=True):
                by_place = {t["place"]: t for t in to.as_py() or ()}
                for place, (fields, block) in enumerate(records(content.as_py() or b"")):
                    yield _renewed(fields, block, by_place.get(place))

    _save(files.select("content", "changes").mapInArrow(lambda batches: _archives(made(batches), archive_bytes), "archive binary"), target)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits in archives: size of
    the full payload, of revisits that of the response that they refer to, whose page_id is refers_to; null where it isn't
    in the archives."""
    headers = cut(index(spark, path).filter(F.col("kind").isin("revisit", *PAYLOADS)))
    to = headers.filter("kind != 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"))
    again = lookup(headers.filter("kind = 'revisit'"), to, ["refers_to"]).select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to_page").alias("refers_to"))
    own = headers.filter("kind != 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)


def page_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The rows of resolved() for pages that are written, deduplicated and read back, under the shared folder.

    Null and empty html are payloads of 0 bytes, equal to each other; null ids are below all others, and a record that
    refers to a page without id has refers_to null; of rows that repeat id and html one is the response and the others
    refer to that id. An empty table gives an empty result. Only the three columns are read, whatever else there is.
    """
    spark = pages.sparkSession
    top = f"{shared_dir(spark)}/parcelry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_pages(pages, f"{top}/written", id_col, url_col, html_col, archive_bytes)
    deduplicate(spark, f"{top}/written", f"{top}/kept", min_bytes, archive_bytes)
    return resolved(spark, f"{top}/kept")


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, from the deduplicated archives."""
    return page_revisits(read(spark, sf_dir, "pages"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload_bytes, list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS parts FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda v:
  substr('{_LETTERS}', ((v >> 15) & 31) + 1, 1) || substr('{_LETTERS}', ((v >> 10) & 31) + 1, 1) || substr('{_LETTERS}', ((v >> 5) & 31) + 1, 1) || substr('{_LETTERS}', (v & 31) + 1, 1)), '') AS payload_digest FROM b),
k AS (SELECT *, payload_bytes >= {MIN_BYTES} AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS original FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to FROM k
"""

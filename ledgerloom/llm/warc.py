"""Legacy archive converter: ARC files to WARC records.

An ARC file begins with a ``filedesc://`` record whose second line says the version and, after it, which fields a
header line has: five in version 1 (URL, IP address, archive date, content type, length), ten in version 2 (with result
code, checksum, location, offset and file name before the length). A record is its header line, as many bytes as the
line declares, and a newline. Fields are split from the right, as a URL may hold blanks.

A converted record gets what its source implies: a name-based record id from file name and offset, the archive date as
a UTC instant, a response (or, where an equal payload stands earlier, a revisit that refers to it), block and payload
digests, and its declared HTTP type.

Defined results: a null or empty html is an empty payload; a null url becomes ``urn:page:<id>``; blanks and line breaks
in a URL are percent-encoded; repeated rows make a record each, and of equal payloads all but one revisit that one; a
null page_id comes after all others; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, small_batches, staged

#: The fields of the two versions' header lines.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payloads from this length on are stored once.
LEAST = 100
#: Bytes of records to an archive, about.
ARCHIVE = 4 << 20
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-records")
EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)


GZIP = b"\x1f\x8b"


def members(parts: list[bytes]) -> bytes:
    """Each part as a gzip member of its own, as archives are kept: a reader can start at any of them."""
    return b"".join(gzip.compress(p, 6, mtime=0) for p in parts)


def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def arc_url(url: str) -> str:
    return "".join(c if c not in " \t\r\n\v\f" else f"%{ord(c):02X}" for c in url)


def write_arc(name: str, version: int, records: list[tuple[str, str, datetime, bytes]]) -> bytes:
    """An ARC file of (url, address, date, payload); payloads get a head of HTTP."""
    about = f"{version} 0 ledgerloom\n{' '.join(FIELDS[version])}\n".encode()
    line = lambda url, ip, date, kind, offset, n: (
        f"{url} {ip} {date} {kind} {n}\n" if version == 1 else f"{url} {ip} {date} {kind} 200 - - {offset} {name} {n}\n"
    ).encode()
    parts = [line(f"filedesc://{name}", "0.0.0.0", EPOCH.strftime("%Y%m%d%H%M%S"), "text/plain", 0, len(about)), about, b"\n"]
    at = sum(map(len, parts))
    for url, ip, date, payload in records:
        block = http_head(len(payload)) + payload
        head = line(arc_url(url), ip, date.strftime("%Y%m%d%H%M%S"), "text/html", at, len(block))
        parts += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(parts)


def read_arc(blob: bytes) -> Iterator[dict]:
    """The records of an ARC file, plain or compressed: header fields by name, ``offset`` (uncompressed) and ``block``."""
    blob = gzip.decompress(blob) if blob[:2] == GZIP else blob
    at, fields = 0, FIELDS[1]
    while at < len(blob):
        end = blob.index(b"\n", at)
        line = blob[at:end].decode("utf-8")
        if not line.strip():
            at = end + 1
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if line.startswith("filedesc://"):
            values = line.split(" ")
            fields = FIELDS[1] if len(values) == len(FIELDS[1]) else FIELDS[2]
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no header line at byte {at}: {line[:80]!r}")
        record = dict(zip(fields, values, strict=True))
        n = int(record["Archive-length"])
        block = blob[end + 1 : end + 1 + n]
        if len(block) < n:
            raise ValueError(f"the record at byte {at} declares {n} bytes, {len(block)} follow")
        if record["URL"].startswith("filedesc://"):
            version, names = block.split(b"\n")[:2]
            fields = names.decode().split(" ")
            if fields != FIELDS.get(int(version.split(b" ")[0])):
                raise ValueError(f"unknown version or fields: {block[:120]!r}")
        else:
            yield record | {"offset": at, "block": block}
        at = end + 1 + n + 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of a block; a block without a head is all payload."""
    if block.startswith(b"HTTP/"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        if mark:
            return head + mark, payload
    return b"", block


def warc_date(arc_date: str) -> str:
    """14 digits, or fewer with the rest at its least, as a UTC instant."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{name}#{offset}')}>"


def _sha(kind, data: bytes) -> str:
    return "sha1:" + base64.b32encode(kind(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_record(record: dict, name: str, page_id: int, digest: str, first: tuple[int, str, str] | None) -> bytes:
    """The WARC record of an ARC record; first: page, id and date of the response that it revisits."""
    head, payload = split_http(record["block"])
    block = head if first else record["block"]
    fields = [
        ("WARC-Record-ID", record_id(name, record["offset"])),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-Date", warc_date(record["Archive-date"])),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Block-Digest", _sha(hashlib.sha1, block)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Source-File", f"{name}#{record['offset']}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Page-ID", str(page_id)),
        ("Content-Type", "application/http; msgtype=response" if head else record["Content-type"]),
    ]
    if first:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", first[1]),
            ("WARC-Refers-To-Date", first[2]),
            ("Refers-To-Page", str(first[0])),
        ]
    return warc_record("revisit" if first else "response", fields, block)


def read_warc(blob: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record of a WARC file, plain or compressed."""
    blob = gzip.decompress(blob) if blob[:2] == GZIP else blob
    at = 0
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        version, *lines = blob[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block = blob[end + 4 : end + 4 + n]
        if len(block) < n or blob[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + n


def arc_files(pages: DataFrame) -> DataFrame:
    """Archives of pages (page_id, url, html): name, the pages in their order, and the file. Versions alternate."""
    small_batches(pages.sparkSession, 500)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            group, size = [], 0
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i, (page, url, html) in enumerate(rows):
                payload = (html or "").encode()
                date = EPOCH + timedelta(seconds=(page or 0) % (20 * 365 * 86400))
                group.append((page, (url or f"urn:page:{page}", f"10.{(page or 0) >> 16 & 255}.{(page or 0) >> 8 & 255}.{(page or 0) & 255}", date, payload)))
                size += len(payload)
                if size >= ARCHIVE or i == len(rows) - 1:
                    ids = [g[0] for g in group]
                    name, version = f"pages-{task:06d}-{count:06d}.arc", 1 + count % 2
                    count += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([gzip.compress(write_arc(name, version, [g[1] for g in group]), 6, mtime=0)], pa.binary())],
                        names=["name", "page_ids", "body"],
                    )
                    group, size = [], 0

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(work, "name string, page_ids array<long>, body binary")


def arc_index(archives: DataFrame) -> DataFrame:
    """One row per ARC record: name, place, page, payload length and digest, WARC id and date."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, ids, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for page, r in zip(ids, read_arc(body), strict=True):
                    payload = split_http(r["block"])[1]
                    out.append((name, r["offset"], page, len(payload), hashlib.sha256(payload).hexdigest(), record_id(name, r["offset"]), warc_date(r["Archive-date"])))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["name", "at", "page_id", "n", "digest", "id", "date"],
            )

    return archives.mapInArrow(work, "name string, at long, page_id long, n long, digest string, id string, date string")


def revisits(index: DataFrame) -> DataFrame:
    """(name, revisits) by archive: the place of each revisit and its response's page, id and date.

    The response is the record with the smallest page, one of them if a page stands on several rows; no page is last.

    Digests are counted before the shuffle; only those that repeat are joined, so a hot payload costs a row a copy.
    """
    large = index.filter(F.col("n") >= LEAST)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "name", "at", "id", "date")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = large.select("digest", "name", "at").join(first, "digest").filter("name != first.name or at != first.at")
    return again.groupBy("name").agg(
        F.collect_list(F.struct("at", F.col("first.page_id").alias("page_id"), F.col("first.id").alias("id"), F.col("first.date").alias("date"))).alias("revisits")
    )


def convert(archives: DataFrame, roles: DataFrame) -> DataFrame:
    """WARC files of ARC files; roles as from ``revisits``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, body, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                firsts = {r["at"]: (r["page_id"], r["id"], r["date"]) for r in known or []}
                target = name.removesuffix(".arc") + ".warc"
                info = f"software: ledgerloom\r\nformat: WARC File Format 1.0\r\nconverted-from: {name}\r\n".encode()
                parts = [warc_record("warcinfo", [("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Filename", target), ("Content-Type", "application/warc-fields")], info)]
                for page, r in zip(ids, read_arc(body), strict=True):
                    digest = hashlib.sha256(split_http(r["block"])[1]).hexdigest()
                    parts.append(convert_record(r, name, page, digest, firsts.get(r["offset"])))
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([members(parts)], pa.binary())], names=["name", "body"])

    return archives.join(roles, "name", "left").select("name", "page_ids", "body", "revisits").mapInArrow(work, "name string, body binary")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of WARC files (name, body); a response's digest is computed again from its block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                for fields, block in read_warc(body):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    n, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response":
                        payload = split_http(block)[1]
                        if (n, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                            raise ValueError(f"payload and digest differ in {fields['WARC-Record-ID']}")
                    page, refers = fields["Page-ID"], fields.get("Refers-To-Page")
                    out.append((None if page == "None" else int(page), n, digest, fields["WARC-Type"], int(refers) if refers and refers != "None" else None, fields["WARC-Record-ID"], fields["WARC-Date"], fields["WARC-Target-URI"]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"],
            )

    return archives.mapInArrow(work, SCHEMA)


def warc_of(pages: DataFrame) -> DataFrame:
    """Archive pages as ARC, convert to WARC, write, and read the records back."""
    archives = staged(arc_files(pages), "arc")
    index = staged(arc_index(archives), "arc-index")
    made = staged(convert(archives, revisits(index)), "warc")
    discard(archives, index)
    return read_back(made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_of(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
n AS (SELECT *, row_number() OVER same AS nth, first_value(page_id) OVER same AS first
  FROM d WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first END AS refers_to
FROM n
"""

"""Legacy web archives (ARC) and their conversion to WARC."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm.workspace import discard, documents, dropped, fresh, raw, stored

# The header lines of the two ARC versions.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: What stands for a page's missing fetch date and address in an archive.
DATE, ADDRESS = "20240101000000", "0.0.0.0"
#: Level of the gzip members that archives are written in; most of the CPU time goes there.
LEVEL = 1
#: Payloads below this are never revisits.
LEAST = 1000
#: Repeated payloads up to this number are broadcast (50 bytes each); more are joined by a shuffle.
BROADCAST_REPEATS = 500_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def _line(text: str) -> str:
    """A header value without spaces or control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _member(record: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is 0 and written by :func:`_write` behind each row.

    That byte is the highest of the record's length; beyond 16 MB, where it may
    not be 0, an empty member follows.
    """
    out = _gzipped(record)
    return (out if out[-1] == 0 else out + _gzipped(b""))[:-1]


def _write(members: DataFrame, path: str) -> None:
    """One file for each partition, a gzip member for each record: Spark's text writer takes any bytes as they are."""
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of one legacy archive: its version block, then a record a page. Partitions alternate the version."""
    part = TaskContext.get().partitionId()
    version = "12"[part % 2]
    name = f"part-{part:05d}.arc"
    head = f"{version} 0 velaspan\n{FIELDS[version]}\n"
    mime = {"1": "text/plain", "2": f"text/plain 200 - - 0 {name}"}[version]
    first = f"filedesc://{name} {ADDRESS} {DATE} {mime} {len(head)}\n{head}\n".encode()
    for batch in batches:
        out = [_member(first)] if first else []
        first = b""
        for key, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = "" if key is None else str(key)
            doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {own}\r\n\r\n"
            extra = "" if version == "1" else f" 200 {hashlib.sha1(body).hexdigest()} - 0 {name}"
            line = f"{_line(url or f'urn:page:{own}')} {ADDRESS} {DATE} text/html{extra} {len(doc) + len(body)}\n"
            out.append(_member(b"".join([line.encode(), doc.encode(), body, b"\n"])))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """Lay pages (page_id, url, html) out as gzipped ARC files, one a partition; null html is empty."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw("html").alias("html"))
    _write(base.mapInArrow(_arc_rows, "value binary"), path)


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of one (gzipped) ARC file, by their declared lengths; the version block says how header lines are read."""
    data = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    fields = None
    while line := data.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        body = data.read(int(values[-1]))
        if len(body) != int(values[-1]):
            raise ValueError(f"record of {len(body)} bytes declares {values[-1]}")
        if fields is None:
            fields = FIELDS[body.split(b" ", 1)[0].decode()].split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"header line has {len(values)} fields, its version {len(fields)}")
        yield dict(zip(fields, values, strict=True)) | {"body": body}


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, head and payload of an HTTP response; any other block is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in lines}, head + gap, payload


def _page(head: dict[str, str]) -> int | None:
    own = head.get("x-page-id", "")
    return int(own) if own.isascii() and own.lstrip("-").isdigit() else None


def _stamp(date: str) -> str:
    """WARC-Date of an ARC date of 14 digits (fewer: the rest is the first moment)."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {page} {digest}')}>"


_PARSED = "page_id long, url string, ip string, date string, mime string, digest string, size long, http boolean, head binary, payload binary"


def _parsed(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _PARSED.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for r in arc_records(content.as_py()):
                head, lines, payload = _http(r["body"])
                rows.append((_page(head), r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], hashlib.sha1(payload).hexdigest(), len(payload), bool(lines), lines if bodies else None, payload if bodies else None))
                held += len(payload)
                if held > 8_000_000 or len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of a folder of ARC files, with the payload's SHA-1; without ``bodies``, head and payload are null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _parsed(batches, bodies), _PARSED)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return b"".join([head.encode(), block, b"\r\n\r\n"])


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    info = _record([("WARC-Type", "warcinfo"), ("WARC-Date", _stamp(DATE)), ("WARC-Record-ID", record_id("warcinfo", DATE, str(part), "")), ("Content-Type", "application/warc-fields")], b"software: velaspan\r\nformat: WARC File Format 1.1\r\n")
    for batch in batches:
        out = [_member(info)] if info else []
        info = b""
        for r in batch.to_pylist():
            page = "" if r["page_id"] is None else str(r["page_id"])
            date, digest = _stamp(r["date"]), r["digest"]
            kind = "revisit" if r["revisit"] else "response" if r["head"] else "resource"
            fields = [("WARC-Type", kind), ("WARC-Target-URI", r["url"]), ("WARC-Date", date), ("WARC-Record-ID", record_id(r["url"], date, page, digest)), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", _sha1(bytes.fromhex(digest))), ("X-Payload-Length", str(r["size"]))]
            block = r["head"] + r["payload"]
            if r["revisit"]:
                first = "" if r["first_id"] is None else str(r["first_id"])
                then = _stamp(r["first_date"])
                fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["first_url"], then, first, digest)), ("WARC-Refers-To-Target-URI", r["first_url"]), ("WARC-Refers-To-Date", then)]
                block = r["head"]
            fields += [("WARC-Block-Digest", _sha1(hashlib.sha1(block).digest())), ("Content-Type", "application/http;msgtype=response" if r["head"] else r["mime"])]
            out.append(_member(_record(fields, block)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST) -> None:
    """Turn a folder of ARC files into WARC files, one for each task, a gzip member for each record.

    An HTTP response becomes a response, or a revisit of the one with the same
    payload (``least`` bytes or more) and the largest page id; without page
    ids, the largest URL and date. Other records (names looked up, images of
    older schemes) become resources of their declared type. Payloads may hold
    any bytes. Only digests are grouped, pre-aggregated; payloads are never
    shuffled while the number of repeated ones allows a broadcast.
    """
    light = read_arc(spark, arc, bodies=False).where((F.col("size") >= least) & F.col("http"))
    groups = light.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url", "date")).alias("first")).where("n > 1")
    repeats = groups.select("digest", F.lit(True).alias("http"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))
    repeats = stored(repeats, "repeats")
    side = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    both = read_arc(spark, arc).join(side, ["digest", "http"], "left")
    same = F.when(F.col("page_id").isNotNull() | F.col("first_id").isNotNull(), F.col("page_id").eqNullSafe(F.col("first_id"))).otherwise((F.col("url") == F.col("first_url")) & (F.col("date") == F.col("first_date")))
    other: Column = F.col("first_date").isNotNull() & ~same & (F.col("size") >= least)
    _write(both.withColumn("revisit", other).mapInArrow(_warc_rows, "value binary"), warc)
    discard(repeats)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one (gzipped) WARC file."""
    data = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, data.read(int(fields["content-length"]))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, url string, date string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in warc_records(content.as_py()):
                if fields["warc-type"] not in ("response", "revisit", "resource"):
                    continue
                head, _, payload = _http(block)
                declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if fields["warc-type"] != "revisit" and declared != hashlib.sha1(payload).hexdigest():
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                rows.append((_page(head), int(fields.get("x-payload-length", len(payload))), declared, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, revisits and resources of a folder of WARC files; a payload that is there is checked against its digest."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _READ)


def converted(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages through ARC, conversion and WARC.

    One row per page row. Null html is an empty payload; a null url or page id
    is kept as such. Repeated rows of the largest page id of a payload are
    responses all. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = fresh(spark, "arc"), fresh(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    dropped(spark, arc)
    got = stored(read_warc(spark, warc), "warc-records")
    targets = got.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    plain = got.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = got.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*columns).union(again.select(*columns))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through legacy archives into WARC and back."""
    return converted(documents(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS first_id, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id <> g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""

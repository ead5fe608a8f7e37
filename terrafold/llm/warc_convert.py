"""Legacy ARC archives to WARC, and WARC records back to rows.

An ARC record is one header line, whose fields and order depend on the version
that the archive's first record names, then as many bytes as the line declares.
Each becomes a WARC record with an identifier made from its content and place,
its time in ISO form, a type, and digests of block and payload. Bodies are bytes of any kind. What cannot be read as a
record is a row of its own that says why, and reading goes on at the next line that can be a header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from terrafold.llm.arrow_map import slices
from terrafold.session import cut, ship_package

# The fields of an ARC header line, by version of the format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard one for URLs
_DATE = "%Y%m%d%H%M%S"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Bytes of the bodies of one ARC archive, unless a single one is longer; its records make one WARC file.
ARC_BYTES = 8 << 20
#: How hard archives are compressed.
LEVEL = 1
ROW_FIELD = "X-Row-Id"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_archive(records: list[dict], version: int = 1, made: str = "20200101000000") -> bytes:
    """An ARC archive of records (url, ip, date, type, body bytes, for version 2 also result and so on), as a crawler of old wrote it."""
    lines = {1: "1 0 terrafold\nURL IP-address Archive-date Content-type Archive-length\n", 2: "2 0 terrafold\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}
    info = lines[version].encode()
    out = [_arc_line({"url": "filedesc://archive.arc", "ip": "0.0.0.0", "date": made, "type": "text/plain"}, len(info), version), info, b"\n"]
    for r in records:
        out += [_arc_line(r, len(r["body"]), version), r["body"], b"\n"]
    return b"".join(out)


def _arc_line(record: dict, length: int, version: int) -> bytes:
    shown = record | {"length": length}
    return (" ".join(re.sub(r"[\s\x00-\x1f]+", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), "-" if shown.get(f) in (None, "") else str(shown[f])) for f in ARC_FIELDS[version]) + "\n").encode()


def shown_url(url: str | None) -> str:
    """A URL as a header line can hold it."""
    return _arc_line({"url": url}, 0, 1).decode().split(" ")[0]


_HEADER = re.compile(rb"\n(?=\S+ \S+ (?:\d{12}|\d{14}) \S+ (?:\S+ ){0,5}\d+\n)")


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive after its description: the header's fields by name, ``body`` bytes, ``at`` (place in the archive), ``reason``.

    The header line's fields are those of the version that the description names. ``reason`` is None, or says why there is
    no record at a place: ``fields`` (another number of them), ``date``, ``length`` (no number, or beyond the archive), ``line`` (no end). Then
    body is the line, and reading goes on at the next line that has a header's form.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        parts = line.decode("utf-8", "replace").split(" ")
        begin, first = end + 1, at == 0
        length = int(parts[-1]) if parts[-1].isascii() and parts[-1].isdigit() else None
        reason = "line" if end < 0 else None if first else "fields" if len(parts) != len(ARC_FIELDS[version]) else None if re.fullmatch(r"\d{12}|\d{14}", parts[2], re.A) and arc_time(parts[2]) else "date"
        if not reason and (length is None or begin + length > len(data)):
            reason = "length"
        if reason:
            yield {"at": at, "reason": reason, "body": line}
            found = _HEADER.search(data, max(at, end))
            at = found.end() if found else len(data)
            continue
        body = data[begin : begin + length]
        if first:
            version = int(body[:1]) if body[:1] in (b"1", b"2") else 1
        else:
            yield dict(zip(ARC_FIELDS[version], parts, strict=True)) | {"body": body, "at": at, "reason": None}
        at = begin + length
        while data[at : at + 1] == b"\n":
            at += 1


def arc_time(date: str) -> datetime | None:
    """The time of a header's date of 14 digits, or of 12, to the minute; None if it is no date."""
    try:
        return datetime.strptime(date if len(date) == 14 else date + "00", _DATE)
    except ValueError:
        return None


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head and payload of a stored response; all is payload where no status line stands."""
    if body.startswith(b"HTTP/"):
        head, mark, payload = body.partition(b"\r\n\r\n")
        if mark:
            return head, payload
    return b"", body


def digest_label(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def record_id(url: str, date: str, sha1: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{place} {date} {sha1} {url}')}>"


def warc_record(arc: dict, place: str, row: str | None = None, origin: dict | None = None) -> bytes:
    """The WARC/1.0 record of an ARC record, with the two line ends after it.

    A body with an HTTP head becomes a response, any other a resource. ``origin``: of a
    revisit, the record (id, url) that holds the payload; the revisit keeps the head, whose length field
    still says how long the payload is. ``row``: kept in a field of our own.
    """
    head, payload = split_http(arc["body"])
    kind = "revisit" if origin else "response" if head else "resource"
    sha1 = hashlib.sha1(payload).hexdigest()
    block = head + b"\r\n\r\n" + (b"" if origin else payload) if head else payload
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {arc['url']}",
        f"WARC-Date: {arc_time(arc['date']).strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Record-ID: {record_id(arc['url'], arc['date'], sha1, place)}",
        f"WARC-IP-Address: {arc['ip']}", f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).hexdigest())}", f"WARC-Payload-Digest: {digest_label(sha1)}",
    ]
    if row is not None:
        lines.append(f"{ROW_FIELD}: {row}")
    if origin:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {origin['id']}", f"WARC-Refers-To-Target-URI: {origin['url']}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else arc['type']}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[dict]:
    """Records as their header fields (names in lower case) and ``block`` bytes, by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        begin, length = end + 4, int(fields["content-length"])
        yield fields | {"block": data[begin : begin + length]}
        at = begin + length + 4


# Rows of pages to archives and back.


def page_place(page_id) -> str:
    return f"page:{page_id}"


def page_date(page_id: int | None) -> str:
    """Pages have no time of their own: a second for each id, from 2020 on, over a hundred years."""
    return datetime.fromtimestamp(1_577_836_800 + (page_id or 0) % 3_155_673_600, tz=timezone.utc).strftime(_DATE)


def page_arc(url: str | None, page_id: int | None, payload: bytes) -> dict:
    own = "" if page_id is None else f"{ROW_FIELD}: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    return {"url": url, "ip": "192.0.2.1", "date": page_date(page_id), "type": "text/html", "body": head.encode() + payload}


def row_of(head: bytes) -> int | None:
    """The row that a stored response says it comes from."""
    found = re.search(rb"(?im)^" + ROW_FIELD.encode() + rb": (-?\d+)\r?$", head)
    return int(found[1]) if found else None


# Files of bytes: Spark's text writer puts out what a string column holds, and after each row the line separator. A gzip
# member ends in the length of what it holds, whose last byte is 0 below 16 MB; that byte is the separator.


def _as_line(members: bytes) -> bytes:
    return (members if members[-1] == 0 else members + gzip.compress(b""))[:-1]


def _write_files(rows: DataFrame, path: str) -> None:
    """One file for each value of a table (value binary)."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, content of all files below ``path``, or of those that it names."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def write_arc_files(pages: DataFrame, path: str) -> None:
    """ARC files below ``path``, in version 1 or 2 by turns, of a table (page_id, url, html)."""
    ship_package(pages.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in slices(batch, 2, ARC_BYTES):
                records = [page_arc(r["url"], r["page_id"], (r["html"] or "").encode()) for r in part.to_pylist()]
                yield pa.RecordBatch.from_pydict({"value": pa.array([_as_line(gzip.compress(arc_archive(records, 1 + n % 2), LEVEL))], pa.binary())})
                n += 1

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write_files(p.mapInArrow(packed, "value binary"), path)


ARC_ROWS = StructType([
    StructField("file", StringType()), StructField("at", LongType()), *[StructField(c, StringType()) for c in ("url", "ip", "date", "type")],
    StructField("row_id", LongType()), StructField("payload_digest", StringType()), StructField("payload_bytes", LongType()), StructField("body", BinaryType()), StructField("reason", StringType()),
])


def read_arc_files(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """One row for each record of the ARC files at ``path`` (either version, plain or gzip): file, at, the header's url, ip, date and type,
    row_id (if the response names one), payload_digest (SHA-1) and payload_bytes of what follows an HTTP head, body.

    What cannot be read is a row with a ``reason`` (see ``read_arc``; ``gzip`` of a file that cannot be unpacked) and the line as body. Without ``bodies`` they are null.
    """
    ship_package(spark)
    kinds = pa.schema([(f.name, {LongType(): pa.int64(), BinaryType(): pa.binary()}.get(f.dataType, pa.string())) for f in ARC_ROWS])

    def records(content: bytes) -> Iterator[dict]:
        try:
            yield from read_arc(content)
        except (OSError, EOFError, zlib.error):
            yield {"at": 0, "reason": "gzip", "body": b""}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, held = [], 0
                for r in records(batch["content"][i].as_py()):
                    head, payload = split_http(r["body"])
                    known = {} if r["reason"] else {"row_id": row_of(head), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
                    out.append({k: r.get(k) for k in ("at", "url", "ip", "date", "type", "reason")} | known | {"file": batch["file"][i].as_py(), "body": r["body"] if bodies else None})
                    held += len(r["body"]) if bodies else 100
                    if held > ARC_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return _files(spark, path).mapInArrow(parse, ARC_ROWS)


def revisits(records: DataFrame) -> DataFrame:
    """file, at, and of the record that holds the equal payload: origin (row_id), origin_url, origin_date, origin_place. Of equal payloads of REVISIT_BYTES or more, that of the largest row_id is the
    origin, the last in place of several; all others with an id of their own revisit it. ``records``: file, at, url, date, row_id, payload_digest, payload_bytes."""
    big = records.filter((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("row_id").isNotNull())
    key = ["payload_digest", "payload_bytes"]
    held = big.groupBy(*key).agg(F.max(F.struct("row_id", "file", "at", "url", "date")).alias("o"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return big.join(held, key).filter("row_id <> o.row_id").select("file", "at", F.col("o.row_id").alias("origin"), F.col("o.url").alias("origin_url"), F.col("o.date").alias("origin_date"), F.col("payload_digest").alias("sha"))


def convert_files(spark: SparkSession, arcs: str, path: str, origins: DataFrame) -> None:
    """A WARC file below ``path`` for each ARC file of ``arcs``, one gzip member a record; ``origins``: see ``revisits``. Places that cannot be read are left out: ``read_arc_files`` lists them."""
    ship_package(spark)
    # As many revisits as a file has records; the files travel packed.
    by_file = origins.groupBy(F.col("file").alias("of")).agg(F.collect_list(F.struct("at", "origin", "origin_url", "origin_date", "sha")).alias("revisits"))
    files = _files(spark, arcs)
    joined = files.join(by_file, files["file"] == by_file["of"], "left").select("content", "file", "revisits")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, members = {r["at"]: r for r in batch["revisits"][i].as_py() or ()}, []
                try:
                    for r in read_arc(batch["content"][i].as_py()):
                        if r["reason"]:
                            continue
                        row, origin = row_of(split_http(r["body"])[0]), None
                        if o := known.get(r["at"]):
                            origin = {"id": record_id(o["origin_url"], o["origin_date"], o["sha"], page_place(o["origin"])), "url": o["origin_url"]}
                        place = f"{batch['file'][i].as_py()}#{r['at']}" if row is None else page_place(row)
                        members.append(gzip.compress(warc_record(r, place, None if row is None else str(row), origin), LEVEL))
                except (OSError, EOFError, zlib.error):
                    continue
                if members:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([_as_line(b"".join(members))], pa.binary())})

    _write_files(joined.mapInArrow(convert, "value binary"), path)


_READ = StructType([StructField("row_id", LongType()), *[StructField(c, StringType()) for c in ("record_id", "record_type", "payload_digest", "refers_id")], StructField("payload_bytes", LongType())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """row_id, record_id, record_type, payload_digest (hexadecimal), refers_id, payload_bytes of every record below ``path``.

    Of a stored payload length and digest are measured; a revisit says both of the payload it stands for.
    """
    ship_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for r in read_warc(data.as_py()):
                    payload = split_http(r["block"])[1]
                    if r["warc-type"] == "revisit":
                        sha1 = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", r["block"])[1])
                    else:
                        sha1, length = hashlib.sha1(payload).hexdigest(), len(payload)
                    row = r.get(ROW_FIELD.lower())
                    rows.append({"row_id": None if row is None else int(row), "record_id": r["warc-record-id"], "record_type": r["warc-type"], "payload_digest": sha1, "refers_id": r.get("warc-refers-to"), "payload_bytes": length})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, pa.int64() if f.dataType == LongType() else pa.string()) for f in _READ]))

    return _files(spark, path).select("content").mapInArrow(parse, _READ)


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id of a revisit) of each page, from archives below ``path``.

    Pages are written as ARC files, these are read and converted to WARC files, and those are read back. Null html is an
    empty payload, a null url is written as ``-``. Pages that repeat in
    id and payload are both responses; a page without id is a response. An empty table
    gives an empty result; other columns take no part.
    """
    spark = pages.sparkSession
    write_arc_files(pages, f"{path}/arc")
    read = cut(read_arc_files(spark, f"{path}/arc", bodies=False).drop("body").filter("reason IS NULL"))
    convert_files(spark, f"{path}/arc", f"{path}/warc", cut(revisits(read)))
    found = cut(read_archives(spark, f"{path}/warc"))
    kept = found.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("row_id").alias("refers_to"))
    # Only records that a revisit names are looked up, once each.
    named = found.filter("refers_id IS NOT NULL").select("refers_id").distinct()
    kept = kept.join(named, "refers_id", "left_semi").distinct()
    return found.join(kept, "refers_id", "left").select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")

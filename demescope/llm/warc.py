"""Legacy ARC archives converted to WARC, written as files and read back."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demescope.llm.common import look_up
from demescope.session import cut_lineage, scratch_path

ARCHIVE_BYTES = 8 << 20
END = b"\r\n\r\n"

# Fixed by the two ARC formats: the fields of a record's header line, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, name: str, offset: int, length: int) -> bytes:
    middle = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def _arc_start(version: int, name: str, date: str) -> bytes:
    about = f"{version} 0 demescope\n{ARC_FIELDS[version]}\n".encode()
    return _arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", name, 0, len(about)) + about + b"\n"


def arc_archives(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """name, content: pages packed in gzipped ARC archives of about 8 MB, versions 1 and 2 by turns.

    The page_id travels in the HTTP header ``X-Page-Id``. Null html is an empty payload; a null url is
    written as ``-``; characters that a header line can't hold are percent-encoded. Names have the partition
    and a count in it, so no two archives of a table share one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        buffer, name, version = bytearray(), "", 1

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"name": [name], "content": pa.array([gzip.compress(bytes(buffer), 1, mtime=0)], pa.binary())}
            )

        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                page, url, html = page.as_py(), url.as_py(), (html.as_py() or b"")
                if not buffer:
                    made += 1
                    version = 1 + made % 2
                    name = f"legacy-{'null' if page is None else page}-{part}-{made}.arc.gz"
                    buffer += _arc_start(version, name, date)
                mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n%sContent-Length: %d\r\n\r\n" % (mark, len(html))
                target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "-"
                buffer += _arc_line(version, target, "0.0.0.0", date, "text/html", name, len(buffer), len(http) + len(html))
                buffer += http + html + b"\n"
                if len(buffer) >= ARCHIVE_BYTES:
                    yield flush()
                    buffer.clear()
        if buffer:
            yield flush()

    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.encode(F.col("html"), "UTF-8").alias("html"))
    return rows.mapInArrow(pack, "name string, content binary")


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of one ARC archive, gzipped or not: header fields, offset and body.

    The version block says which fields a header line has; a body is as long as its line declares. A
    length that reaches beyond the archive, or a line with too few fields, raises ValueError.
    """
    plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, names = 0, None
    while at < len(plain):
        if plain[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = plain.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header line without end at {at}")
        line = plain[at:stop].decode("utf-8", "replace").rstrip("\r")
        version_2 = names is not None and len(names) == 10
        if names is None:
            if not line.startswith("filedesc://"):
                raise ValueError("not an ARC archive: no version block")
            length = int(line.rsplit(" ", 1)[1])
            names = plain[stop + 1 : stop + 1 + length].decode("utf-8", "replace").splitlines()[1].split(" ")
            at = stop + 1 + length
            continue
        fields = line.rsplit(" ", len(names) - 1)
        if len(fields) < len(names):
            raise ValueError(f"ARC header line with {len(fields)} fields at {at}")
        length = int(fields[-1])
        if stop + 1 + length > len(plain):
            raise ValueError(f"ARC record longer than its archive at {at}")
        yield {
            "uri": fields[0],
            "ip": fields[1],
            "date": fields[2],
            "mime": fields[3],
            "version": 2 if version_2 else 1,
            "offset": at,
            "body": plain[stop + 1 : stop + 1 + length],
        }
        at = stop + 1 + length


RECORD = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("ip", pa.string()),
        ("date", pa.string()),
        ("http", pa.binary()),
        ("payload", pa.binary()),
        ("sha1", pa.string()),
        ("bytes", pa.int64()),
    ]
)
RECORD_DDL = (
    "archive string, offset bigint, page_id bigint, record_id string, uri string, ip string, date string, "
    "http binary, payload binary, sha1 string, bytes bigint"
)


def _page_of(http: bytes) -> int | None:
    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
    return int(found[1]) if found else None


def arc_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per ARC record with what its WARC record needs: identifier, timestamp, HTTP header, digest.

    The identifier is a name-based UUID of archive, offset and digest, so a lost task makes it again.
    Without ``payloads`` that column is null.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name, rows, size = name.as_py(), [], 0
                for r in parse_arc(content.as_py()):
                    head, gap, payload = r["body"].partition(END)
                    if not head.startswith(b"HTTP/") or not gap:
                        head, payload = b"", r["body"]
                    sha1 = hashlib.sha1(payload).hexdigest()
                    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{r['offset']}#{sha1}")
                    d = r["date"].ljust(14, "0")
                    stamp = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append(
                        (name, r["offset"], _page_of(head), f"<urn:uuid:{ident}>", r["uri"], r["ip"], stamp, head)
                        + (payload if payloads else None, sha1, len(payload))
                    )
                    size += len(payload)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    return archives.select("name", "content").mapInArrow(parse, RECORD_DDL)


def convert_arc(archives: DataFrame, path: str, least_bytes: int = 1000, records_per_file: int = 20_000) -> None:
    """Writes the records of ARC archives (name, content) as gzipped WARC files below ``path``.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest page_id (then
    record identifier) is a response, the others revisit it without a payload; smaller ones are all
    responses. Every record ends with two CRLF, which is the line separator of Spark's text writer, so the
    files come from its commit protocol. Archives are read twice: once for digests alone.
    """
    narrow = cut_lineage(arc_records(archives, payloads=False).select("archive", "offset", "page_id", "record_id", "uri", "date", "sha1", "bytes"))
    target = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "record_id", "uri", "date"))
    groups = narrow.filter(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(target.alias("to"), F.count("*").alias("n"))
    groups = cut_lineage(groups.filter("n > 1"))
    repeated = look_up(narrow.select("archive", "offset", "record_id", "sha1", "bytes"), groups, ["sha1", "bytes"], "n")
    revisits = cut_lineage(repeated.filter(F.col("to.record_id") != F.col("record_id")).select("archive", "offset", "to"))
    full = arc_records(archives).join(revisits, ["archive", "offset"], "left")
    is_revisit = F.col("to").isNotNull()
    http = F.when(F.octet_length("http") > 0, F.concat("http", F.lit(END))).otherwise(F.lit(b""))
    body = F.when(is_revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("X-Payload-Bytes", F.col("bytes").cast("string")),
        F.when(
            is_revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.col("to.record_id")),
                line("WARC-Refers-To-Target-URI", F.col("to.uri")),
                line("WARC-Refers-To-Date", F.col("to.date")),
            ),
        ).otherwise(""),
        line("Content-Type", F.when(F.octet_length("http") > 0, "application/http; msgtype=response").otherwise("text/html")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(F.encode(header, "UTF-8"), body).cast("string")
    writer = full.select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(source) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record of an open WARC file, by declared lengths."""
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields["content-length"])
        block = source.read(length)
        if len(block) != length:
            raise ValueError("WARC record shorter than it declares")
        yield fields, block


READ_DDL = "page_id bigint, record_id string, uri string, record_type string, refers_id string, payload_bytes bigint, payload_digest string, payload binary"
READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("record_type", pa.string()),
        ("refers_id", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the WARC files below ``path``.

    A response's digest and length are taken from its payload and have to agree with its header, else
    ValueError; a revisit has them from its header alone.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                source = gzip.GzipFile(fileobj=raw) if raw.getvalue()[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for fields, block in parse_warc(source):
                    http, gap, payload = block.partition(END)
                    if not fields["content-type"].startswith("application/http") or not gap:
                        http, payload = b"", block
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    length = int(fields.get("x-payload-bytes", len(payload)))
                    if fields["warc-type"] == "response":
                        if hashlib.sha1(payload).hexdigest() != digest or length != len(payload):
                            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                    rows.append(
                        (_page_of(http), fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-type"])
                        + (fields.get("warc-refers-to"), length, digest, payload if payloads else None)
                    )
                    size += len(payload) * payloads
                    if size > ARCHIVE_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(parse, READ_DDL)


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages sent through ARC and WARC.

    Pages become ARC archives, these are converted to WARC files in the shared folder, and the rows come
    from reading the files. Null html is an empty payload; a null page_id stays null; repeated pages are
    records of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    archives = cut_lineage(arc_archives(pages))
    path = scratch_path(spark, "warc")
    convert_arc(archives, path)
    records = cut_lineage(read_warc(spark, path, payloads=False).drop("payload"))
    responses = records.filter("record_type = 'response'")
    pointed = records.filter(F.col("refers_id").isNotNull()).groupBy("refers_id").agg(F.count("*").alias("n"))
    targets = cut_lineage(pointed.join(responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")), "refers_id"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = look_up(records.filter(F.col("refers_id").isNotNull()), targets, ["refers_id"], "n")
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(columns).union(revisits.select(columns))

"""Legacy web archives (ARC versions 1 and 2) converted to WARC.

ARC has no record ids, no record types and no digests: a record is one header
line, whose fields depend on the version named in the file's first record, and as
many bytes as the line declares. The converter parses that, then synthesises what
WARC wants: a record id derived from file, offset and digest, an ISO timestamp,
the type (warcinfo for the file's own record, response for HTTP messages, else
resource; revisit for a repeated payload) and SHA-256 digests.

Archives are text files of Spark's own writer whose record separator is the
format's (``\\n`` for ARC, two CRLF for WARC): writes commit or vanish with their
task, and every path that Spark opens will do. Texts pass as bytes throughout.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope.llm.common import TEXT_BYTES, pick, stored

#: Shortest payload that a later record may refer to instead of repeating it.
LEAST_REVISIT = 100
CRLF = b"\r\n"
#: Fields of a header line by the version number of the file.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
_SLICE = 1 << 20


def arc_record(version: int, url: str, date: str, page_id: int | None, payload: bytes) -> bytes:
    """One ARC record: header line and HTTP message (without the separator)."""
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own
    message = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    link = _one_field(url)
    if version == 1:
        line = f"{link} 0.0.0.0 {date} text/html {len(message)}\n"
    else:
        line = f"{link} 0.0.0.0 {date} text/html 200 - - 0 pages.arc {len(message)}\n"
    return line.encode("utf-8", "surrogatepass") + message


def _one_field(text: str) -> str:
    """Header lines are separated by blanks, so those inside a field are escaped."""
    kept = "".join(c if c > " " and c != "%" else f"%{ord(c):02X}" for c in text)
    return kept or "-"


def version_block(version: int) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length"}
    names[2] = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 huescope\n{names[version]}\n"
    return f"filedesc://pages.arc 0.0.0.0 19960923142103 text/plain {len(body)}\n{body}".encode()


def write_arc(pages: DataFrame, path: str, date: str = "20240102030405") -> None:
    """Write page_id, url, html as gzipped ARC files of both versions, one per partition.

    Null url counts as empty, null html as an empty payload.
    """
    from pyspark import TaskContext

    chosen = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("html").cast("binary")
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        out, held = [version_block(version)], 0
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html = (c[at].as_py() for c in batch.columns)
                out.append(arc_record(version, url, date, page_id, html or b""))
                held += len(out[-1])
                if held >= TEXT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = chosen.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Bytes:
    """Reads a gzipped or plain archive from memory with a bounded window."""

    def __init__(self, content: bytes):
        self.rest = memoryview(content)
        self.unpack = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.window, self.place = bytearray(), 0

    def _more(self) -> bool:
        if self.unpack is None:
            part, self.rest = bytes(self.rest[:_SLICE]), self.rest[_SLICE:]
        else:
            part = b""
            while not part and (self.rest or not self.unpack.eof):
                if self.unpack.eof:  # the next member of the file
                    if bytes(self.rest[:2]) != b"\x1f\x8b":
                        break
                    self.unpack = zlib.decompressobj(31)
                given, self.rest = bytes(self.rest[:_SLICE]), self.rest[_SLICE:]
                if not given:
                    break
                part = self.unpack.decompress(given)
                if self.unpack.eof:
                    self.rest = memoryview(self.unpack.unused_data + bytes(self.rest))
        self.window += part
        return bool(part)

    def take(self, count: int) -> bytes:
        while len(self.window) < count and self._more():
            pass
        part = bytes(self.window[:count])
        del self.window[:count]
        self.place += len(part)
        return part

    def line(self) -> bytes:
        """Up to and with the next line end; empty at the end of the file."""
        searched = 0
        while (at := self.window.find(b"\n", searched)) < 0:
            searched = len(self.window)
            if not self._more():
                return self.take(len(self.window))
        return self.take(at + 1)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file: the fields of its header line, start, block (bytes).

    A header line has the fields of the version that the file's first record names.
    A line that declares no valid length ends the file, since nothing behind it can
    be located: it gives a record with the line as its ``error`` and no block.
    """
    source, fields = _Bytes(content), FIELDS[1]
    while True:
        start, line = source.place, source.line()
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if parts[0].startswith("filedesc:"):
            parts = [*parts[:4], parts[-1]]
            names = FIELDS[1]
        else:
            names = fields
        if len(parts) != len(names) or not parts[-1].isdigit():
            yield {"start": start, "error": line.decode("utf-8", "replace").rstrip("\r\n")}
            return
        record = dict(zip(names, parts)) | {"start": start}
        record["block"] = source.take(int(parts[-1]))
        if parts[0].startswith("filedesc:"):
            number = record["block"].split(b" ", 1)[0]
            fields = FIELDS.get(int(number) if number.isdigit() else 1, FIELDS[1])
        yield record


def message_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header block (with its blank line) and payload of an HTTP message."""
    head, mark, payload = block.partition(CRLF + CRLF)
    return (head + mark, payload) if mark else (b"", block)


def header_value(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(CRLF):
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == name.lower():
            return value.strip()
    return None


ARC_ROWS = (
    "record_id string, kind string, url string, ip string, date string, type string, "
    "page_id long, digest string, payload_bytes long, head binary, payload binary"
)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files below a path, with synthesised ids, types and digests.

    A file that cannot be read to its end gives a row of kind ``error`` with the
    header line at fault in ``type``, the file's name in ``url`` and no payload.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(content_of: str, content: bytes) -> Iterator[tuple]:
        name = content_of.rsplit("/", 1)[-1]
        for r in parse_arc(content):
            if "error" in r:
                fault = f"{name}#{r['start']}"
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, fault)
                yield f"urn:uuid:{record_id}", "error", fault, "", "", r["error"][:1000], None, "", 0, b"", b""
                return
            http = r["block"].startswith(b"HTTP/")
            head, payload = message_parts(r["block"]) if http else (b"", r["block"])
            digest = hashlib.sha256(payload).hexdigest()
            kind = "warcinfo" if r["url"].startswith("filedesc:") else "response" if http else "resource"
            page = header_value(head, b"X-Page-Id")
            record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{r['start']}#{digest}")
            yield (
                f"urn:uuid:{record_id}", kind, r["url"], r["ip"], iso_date(r["date"]), r["type"],
                int(page) if page else None, digest, len(payload), head, payload,
            )

    return _per_file(files, rows, ARC_ROWS)


def iso_date(digits: str) -> str:
    """ARC's fourteen digits (fewer: padded) as a WARC timestamp."""
    d = digits[:14].ljust(4, "0")
    d += "0101000000"[len(d) - 4 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _per_file(files: DataFrame, rows, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pending, held = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    pending.append(row)
                    held += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held > 8_000_000:
                        yield _arrow(pending, target)
                        pending, held = [], 0
                if pending:
                    yield _arrow(pending, target)

    return files.mapInArrow(run, schema)


def _arrow(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


def revisits(arc: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """record_id, first (record_id, url, date): each repeated response and the one that it refers to.

    Payloads don't move: rows without them meet by digest, and what is kept of a
    digest is folded by the map tasks. A digest with a third of all responses has
    as many small rows, which adaptive execution splits.
    """
    eligible = arc.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_revisit))
    small = stored(eligible.select("digest", "payload_bytes", "page_id", "record_id", "url", "date"), "responses")
    own = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    key = ["digest", "payload_bytes"]
    firsts = small.groupBy(*key).agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("records"))
    paired = small.select(*key, "record_id").join(firsts.where("records > 1"), key)
    return paired.where("first.record_id <> record_id").select("record_id", "first").dropDuplicates(["record_id"])


def convert(arc: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """WARC records of the rows of ``read_arc``: kind, page_id and the record's bytes.

    Of responses with equal payloads of at least ``least_revisit`` bytes the one
    with the smallest page_id (then record id) stays a response; the others become
    revisits that refer to it and hold no payload. Records without a page_id come
    last. Rows of kind ``error`` are no records and are left out. Records find
    their reference by their own id.
    """
    joined = arc.where("kind <> 'error'").join(revisits(arc, least_revisit), "record_id", "left")
    joined = joined.withColumn("again", F.col("first").isNotNull())
    kind = F.when(F.col("again"), "revisit").otherwise(F.col("kind"))
    block_bytes = F.octet_length("head") + F.when(F.col("again"), 0).otherwise(F.octet_length("payload"))
    of_type = (
        F.when(F.col("kind") == "warcinfo", "application/warc-fields")
        .when(F.col("kind") == "response", "application/http; msgtype=response")
        .otherwise(F.col("type"))
    )
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <"), F.col("record_id"),
        F.lit(">\r\nWARC-Date: "), F.col("date"),
        F.when(F.col("kind") == "warcinfo", F.lit("")).otherwise(
            F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-IP-Address: "), F.col("ip"))
        ),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(
            F.col("again"),
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: <"), F.col("first.record_id"),
                F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("first.url"),
                F.lit("\r\nWARC-Refers-To-Date: "), F.col("first.date"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: "), of_type,
        F.lit("\r\nContent-Length: "), block_bytes.cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(F.col("again"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(lines.cast("binary"), F.col("head"), body)
    return joined.select(kind.alias("kind"), "page_id", record.alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files; each record ends with two CRLF."""
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header lines and block of each record; the block has its declared length."""
    source = _Bytes(content)
    while line := source.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = bytearray()
        while (line := source.line()).strip():
            head += line
        yield bytes(head), source.take(int(header_value(bytes(head), b"Content-Length") or 0))


WARC_ROWS = (
    "record_id string, kind string, refers_to string, page_id long, payload_bytes long, payload_digest string"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below a path; digests and lengths of stored payloads are recomputed.

    A revisit has no payload: its digest and length are those its headers state.
    A stored payload that disagrees with its digest raises.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(_: str, content: bytes) -> Iterator[tuple]:
        for head, block in parse_warc(content):
            kind = (header_value(head, b"WARC-Type") or b"").decode()
            message, payload = message_parts(block) if block.startswith(b"HTTP/") else (b"", block)
            stated = (header_value(head, b"WARC-Payload-Digest") or b"").decode().removeprefix("sha256:")
            page = header_value(message, b"X-Page-Id")
            if kind == "revisit":
                digest, size = stated, int(header_value(message, b"Content-Length") or 0)
            else:
                digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                if digest != stated:
                    raise ValueError("a payload disagrees with its digest")
            name, refers = (
                (header_value(head, key) or b"").decode().strip("<>") for key in (b"WARC-Record-ID", b"WARC-Refers-To")
            )
            yield name, kind, refers or None, int(page) if page else None, size, digest

    return _per_file(files, rows, WARC_ROWS)


def page_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id)."""
    found = stored(read_warc(spark, warc_path), "warc-rows")
    pages = found.where(F.col("kind").isin("response", "revisit"))
    named = found.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"))
    return pages.join(named, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("first").alias("refers_to")
    )

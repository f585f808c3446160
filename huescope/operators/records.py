"""Archived records: cut out, decode, status, resume.

Decompression, de-chunking and character sets are the one part of the data path
that runs in Python, in Arrow batches. Records are independent of each other;
Spark spreads them over archive regions, not over whole archives.
"""

from __future__ import annotations

import codecs
import gzip
import io
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.functions import http
from huescope.functions.frames import settled
from huescope.sources.pages import safe_name

# Executors may not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of records that a task reads; a step behind it may get them all in one batch.
REGION_BYTES = 16 * 1024 * 1024
#: Bytes of an archive that one row holds when archives are tables.
BLOCK_BYTES = 4 * 1024 * 1024

DECODED = {
    "charset": ("STRING", pa.string()),
    "chunked": ("BOOLEAN", pa.bool_()),
    "html": ("STRING", pa.string()),
    "status": ("STRING", pa.string()),
    "size": ("BIGINT", pa.int64()),
    "error": ("STRING", pa.string()),
}

#: Bytes of record and text that one output batch may hold before it is handed on. An executor
#: runs up to two such steps for each of its cores, and each holds a batch several times over.
BATCH_BYTES = 4 * 1024 * 1024

#: Bytes that one record may unpack to; a larger one is an ``error`` row.
UNPACKED_LIMIT = 256 * 1024 * 1024
_SLICE = 1024 * 1024

# A chunk's size line, with the line end of the chunk before it and an extension.
_CHUNK_SIZE = re.compile(rb"\s*([0-9a-f]+)[ \t]*(?:;[^\n]*)?\r\n", re.IGNORECASE)


def archive_blocks(archive: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, bytes): archives of a table (path, content) cut into blocks of fixed size."""
    last = F.floor((F.greatest(F.octet_length("content"), F.lit(1)) - 1) / block_bytes)
    numbered = archive.select("path", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    cut = F.expr(f"substring(content, int(block * {block_bytes}) + 1, {block_bytes})")
    return numbered.select("path", "block", cut.alias("bytes"))


def _block_pieces(index: DataFrame, block_bytes: int) -> DataFrame:
    """Index rows once for each block that they reach into; a range that is none has a null block."""
    size = F.lit(block_bytes)
    begin, end = F.col("offset"), F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1
    is_range = (F.col("offset") >= 0) & (F.col("length") >= 0)
    first, last = F.floor(begin / size), F.floor(end / size)
    reached = F.when(is_range, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("bigint")))
    return index.withColumn("__pieces", F.size(reached)).withColumn("__block", F.explode(reached))


def _joined_to_blocks(pieces: DataFrame, blocks: DataFrame, block_bytes: int) -> DataFrame:
    """Add ``__bytes``: the part of each block that belongs to the row's range."""
    same = (F.col("filename") == F.col("path")) & (F.col("__block") == F.col("block"))
    found = pieces.join(blocks, same, "left")
    start = f"greatest(offset - __block * {block_bytes}, 0)"
    stop = f"least(offset + length - __block * {block_bytes}, {block_bytes})"
    part = F.expr(f"substring(bytes, int({start}) + 1, int({stop} - {start}))")
    begun = F.expr(f"{start} < greatest(octet_length(bytes), 1)")
    return found.select(*pieces.columns, F.when(begun, part).alias("__bytes"))


def slice_records(index: DataFrame, archive: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``content``, the record's bytes, from a table (path, content) of archives.

    Archives are cut into blocks and records join the blocks that they reach into,
    on (file, block): a key has as many records as fit into a block, however many
    its archive has, and no row carries more than a block. Records of one block
    are done then; the parts of longer ones meet by record.

    ``content`` is NULL where the archive is not there, the range begins behind its
    end, or is no range; a range that ends behind it gives what there is. Repeated
    index rows stay repeated. Archive files are read by ``read_records``.
    """
    blocks = archive_blocks(archive, block_bytes)
    pieces = _block_pieces(index, block_bytes)
    single = _joined_to_blocks(pieces.where("__pieces = 1"), blocks, block_bytes)
    done = single.select(*index.columns, F.col("__bytes").alias("content"))
    # equal index rows are counted, so that their parts aren't mixed up
    several = pieces.where("__pieces > 1").groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("__copies"))
    parts = F.array_sort(F.collect_list(F.struct("__block", "__bytes")))
    grouped = (
        _joined_to_blocks(several, blocks, block_bytes)
        .groupBy(*index.columns, "__copies")
        .agg(parts.alias("__parts"))
    )
    # behind the archive's end there are no blocks; collected parts without bytes add nothing
    empty = F.lit(b"")
    whole = F.aggregate(
        "__parts", empty, lambda done, p: F.concat(done, F.coalesce(p.getField("__bytes"), empty))
    )
    starts = F.get("__parts", F.lit(0)).getField("__bytes").isNotNull()
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))
    put = grouped.select(*index.columns, F.when(starts, whole).alias("content"), repeated.alias("__copy"))
    return done.unionByName(put.drop("__copy"))


def fetch_tasks(index: DataFrame) -> int:
    """A task for every ``REGION_BYTES`` of records: one aggregate over the index."""
    total = index.agg(F.sum(F.greatest(F.col("length"), F.lit(0)))).first()[0] or 0
    return max(1, -(-int(total) // REGION_BYTES))


def _by_region(index: DataFrame, tasks: int) -> DataFrame:
    """Neighbouring records to one task, a large archive to many tasks.

    The number of tasks is given: index rows are small, and partitions sized by
    their bytes would be merged although each row stands for a whole record.
    """
    region = F.floor(F.col("offset") / F.lit(REGION_BYTES))
    return index.repartition(tasks, "filename", region).sortWithinPartitions("filename", "offset")


class _Archives:
    """Range reads below a root; one file is open at a time."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(root)
        self.name, self.handle = None, None

    def read(self, filename: str | None, offset: int | None, length: int | None) -> bytes:
        if filename is None or offset is None or length is None or offset < 0 or length < 0:
            raise ValueError(f"no such range: {filename}, {offset}, {length}")
        if filename != self.name:
            self.close()
            self.handle = self.system.open_input_file(f"{self.base}/{filename}")
            self.name = filename
        return self.handle.read_at(length, offset)

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.name, self.handle = None, None


def _outcomes(batches, kept: list[str], made: dict[str, pa.DataType], outcome):
    """Batches of the kept columns and what ``outcome(row)`` makes of each row.

    A batch is handed on as soon as its outcomes hold BATCH_BYTES, so memory does
    not depend on how many rows Spark sends at once; one larger record goes alone.
    Nothing of a batch is held while the next is read.
    """
    for batch in batches:
        rows = batch.to_pylist() if "content" not in batch.schema.names else _row_by_row(batch)
        begin, held, pending = 0, 0, []
        for at, row in enumerate(rows, start=1):
            pending.append(outcome(row))
            held += sum(len(v) for v in pending[-1].values() if isinstance(v, str | bytes))
            if held >= BATCH_BYTES or at == batch.num_rows:
                columns = [batch.column(name).slice(begin, at - begin) for name in kept]
                columns += [pa.array([p[n] for p in pending], kind) for n, kind in made.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])
                columns, begin, held, pending = None, at, 0, []
        batch = rows = None


def _row_by_row(batch):
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _content(archives: _Archives, row: dict) -> dict:
    try:
        return {"content": archives.read(row["filename"], row["offset"], row["length"])}
    except (OSError, ValueError):
        archives.close()
        return {"content": None}


def _read_batches(batches, root: str, kept: list[str]):
    archives = _Archives(root)
    try:
        yield from _outcomes(batches, kept, {"content": pa.binary()}, lambda row: _content(archives, row))
    finally:
        archives.close()


def read_records(index: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Add ``content`` by range reads from the archive files under ``root``.

    NULL where the range or file cannot be read. ``tasks`` defaults to ``fetch_tasks``.
    """
    kept = index.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return _by_region(index, tasks or fetch_tasks(index)).mapInArrow(
        lambda batches: _read_batches(batches, root, kept), f"{fields}, content binary"
    )


def _message(data: bytes) -> tuple[dict[str, list[str]], bytes] | None:
    """Header fields and body of the archived response, None if either block has no end."""
    for _ in ("archive's own headers", "response headers"):
        blank = b"\r\n\r\n" if b"\r\n\r\n" in data else b"\n\n"
        head, end, data = data.partition(blank)
        if not end:
            return None
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", errors="replace").lower().split("\n"):
        name, _, value = line.partition(":")
        fields.setdefault(name, []).append(value)
    fields["*"] = [head.decode("utf-8", errors="replace").lower()]
    return fields, data


def _charset(fields: dict[str, list[str]]) -> str:
    """What the first content type that names a character set names last; else UTF-8."""
    named = [v.rpartition("charset=")[2] for v in fields.get("content-type", []) if "charset=" in v]
    return named[0].strip().rstrip(";").strip() if named else "utf-8"


def _chunks(body: bytes):
    """Payloads of a chunked body up to its empty chunk or the first malformed size line."""
    size_line = _CHUNK_SIZE.match(body)
    while size_line and (size := int(size_line[1], 16)):
        yield body[size_line.end() : size_line.end() + size]
        size_line = _CHUNK_SIZE.match(body, size_line.end() + size)


def _unpacked(raw: bytes, limit: int) -> bytes:
    """Gzip members unpacked slice by slice; bytes that are no gzip as they are.

    A cut-off member raises EOFError, more than ``limit`` bytes ValueError as soon
    as they are seen, so a small record cannot fill the memory.
    """
    done = bytearray()
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as members:
            while part := members.read(_SLICE):
                done += part
                if len(done) > limit:
                    raise ValueError(f"record unpacks to more than {limit} bytes")
    except OSError:
        return raw
    return bytes(done)


def _text(body: bytes, charset: str) -> str:
    """The body in its character set; in UTF-8 where that is unknown or no text encoding."""
    try:
        known = codecs.lookup(charset)
        usable = getattr(known, "_is_text_encoding", True)
    except (LookupError, ValueError):
        usable = False
    if usable:
        try:
            return known.decode(body, "replace")[0]
        except UnicodeDecodeError:  # some codecs can't replace
            pass
    return body.decode("utf-8", "replace")


def _decode_record(raw: bytes | None, limit: int, anchored: bool) -> dict:
    """Charset, chunking, text and outcome of one record."""
    outcome = dict.fromkeys(DECODED) | {"status": "failed"}
    if raw is None:
        return outcome
    message = _message(_unpacked(raw, limit))
    if message is None:
        return outcome
    fields, body = message
    outcome["charset"] = _charset(fields)
    if anchored:
        codings = (v.rpartition(",")[2].strip() for v in fields.get("transfer-encoding", []))
        outcome["chunked"] = "chunked" in codings
    else:
        outcome["chunked"] = "transfer-encoding: chunked" in fields["*"][0]
    html = _text(b"".join(_chunks(body)) if outcome["chunked"] else body, outcome["charset"])
    if html:
        html.encode("utf-8")
        outcome |= {"html": html, "status": "ok", "size": len(html)}
    return outcome


def _guarded(record, limit: int = UNPACKED_LIMIT, anchored: bool = False) -> dict:
    """The decoded record; any failure to read or decode is its status."""
    try:
        return _decode_record(record(), limit, anchored)
    except Exception as problem:  # noqa: BLE001
        return dict.fromkeys(DECODED) | {"status": "error", "error": str(problem) or type(problem).__name__}


_DECODED_TYPES = {n: kind for n, (_, kind) in DECODED.items()}


def _fetch_batches(batches, root: str, kept: list[str], limit: int, anchored: bool):
    archives = _Archives(root)

    def outcome(row: dict) -> dict:
        return _guarded(lambda: archives.read(row["filename"], row["offset"], row["length"]), limit, anchored)

    try:
        yield from _outcomes(batches, kept, _DECODED_TYPES, outcome)
    finally:
        archives.close()


def _decoded_schema(df: DataFrame, kept: list[str]) -> str:
    fields = [f"{name} {df.schema[name].dataType.simpleString()}" for name in kept]
    return ", ".join([*fields, *(f"{n} {sql}" for n, (sql, _) in DECODED.items())])


def decode_records(records: DataFrame, limit: int = UNPACKED_LIMIT, anchored: bool = False) -> DataFrame:
    """Replace ``content`` by charset, chunked, html, status, size and error.

    A record never fails its task: ``failed`` stands for no text, ``error`` for
    undecodable bytes and for records that unpack to more than ``limit`` bytes.
    ``anchored`` as in ``http.is_chunked``.
    """
    kept = [c for c in records.columns if c != "content"]

    def decoded(row: dict) -> dict:
        return _guarded(lambda: row["content"], limit, anchored)

    return records.mapInArrow(
        lambda batches: _outcomes(batches, kept, _DECODED_TYPES, decoded), _decoded_schema(records, kept)
    )


def fetch_pages(
    index: DataFrame, root: str, tasks: int | None = None, limit: int = UNPACKED_LIMIT, anchored: bool = False
) -> DataFrame:
    """Read and decode in one pass: each record is decoded before the next is read.

    A range or file that cannot be read is an ``error`` row like undecodable bytes.
    ``tasks`` defaults to ``fetch_tasks``; the rest as for ``decode_records``.
    """
    kept = index.columns
    return _by_region(index, tasks or fetch_tasks(index)).mapInArrow(
        lambda batches: _fetch_batches(batches, root, kept, limit, anchored), _decoded_schema(index, kept)
    )


def _unpacked_content(row: dict, limit: int) -> dict:
    try:
        return {"content": None if row["content"] is None else _unpacked(row["content"], limit)}
    except Exception:  # noqa: BLE001
        return {"content": None}


def unpack_records(records: DataFrame, limit: int = UNPACKED_LIMIT) -> DataFrame:
    """``content`` without compression; NULL for undecodable records and those beyond ``limit`` bytes."""
    kept = [c for c in records.columns if c != "content"]
    fields = [f"{name} {records.schema[name].dataType.simpleString()}" for name in kept]

    def unpacked(row: dict) -> dict:
        return _unpacked_content(row, limit)

    return records.mapInArrow(
        lambda batches: _outcomes(batches, kept, {"content": pa.binary()}, unpacked),
        ", ".join([*fields, "content binary"]),
    )


def response_headers(unpacked: DataFrame, anchored: bool = False) -> DataFrame:
    """Replace ``content`` by headers (MAP<STRING, ARRAY<STRING>>), charset and chunked.

    Column expressions only; NULLs where a record or one of its two header blocks
    has no end. ``anchored`` as in ``http.is_chunked``.
    """
    kept = [F.col(c) for c in unpacked.columns if c != "content"]
    rest = settled(unpacked, kept, {"__rest": http.response(F.col("content"))})
    block = settled(rest, kept, {"__block": http.header_block(F.col("__rest"))})
    fields = settled(block, [*kept, F.col("__block")], {"headers": http.header_fields(F.col("__block"))})
    return fields.select(
        *kept,
        "headers",
        http.charset(F.col("headers")).alias("charset"),
        http.is_chunked(F.col("__block"), F.col("headers"), anchored).alias("chunked"),
    )


def resume_pending(index: DataFrame, existing: DataFrame) -> DataFrame:
    """Index rows whose page is not stored yet; the key is the safe name."""
    done = existing.select(safe_name(F.col("domain")).alias("__name"))
    named = index.withColumn("__name", safe_name(F.col("domain")))
    return named.join(done, "__name", "left_anti").drop("__name")


def record_status(decoded: DataFrame) -> DataFrame:
    """The fetch log: one outcome per record."""
    return decoded.select("domain", "status", "size", "error")


def fetch_counts(log: DataFrame) -> DataFrame:
    """(fetched, failed) as one row; errors count as failed."""
    return log.agg(
        F.count_if(F.col("status") == "ok").alias("fetched"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )

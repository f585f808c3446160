import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huescope.operators import records as rec
from huescope.sources.pages import scan_pages

HEAD = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n"


def record(headers: bytes, body: bytes) -> bytes:
    return HEAD + headers + b"\r\n\r\n" + body


CASES = {
    "plain": (record(b"Content-Type: text/html", "<p>é".encode()), "<p>é", "ok"),
    "gzip": (gzip.compress(record(b"X: y", b"<p>z")), "<p>z", "ok"),
    "two members": (gzip.compress(record(b"X: y", b"<p>")) + gzip.compress(b"more"), "<p>more", "ok"),
    "truncated gzip": (gzip.compress(record(b"X: y", b"<p>z" * 50))[:-12], None, "error"),
    "newlines only": (b"WARC/1.0\n\nHTTP/1.1 200\nA: b\n\nbody", "body", "ok"),
    "no envelope end": (b"WARC/1.0\r\nbody", None, "failed"),
    "no header end": (b"WARC/1.0\r\n\r\nHTTP/1.1 200", None, "failed"),
    "empty body": (record(b"X: y", b""), None, "failed"),
    "latin": (record(b"Content-Type: text/html; charset=ISO-8859-1", b"\xe9"), "é", "ok"),
    "last charset": (record(b"content-type: a; charset=x; charset= Windows-1252 ;", b"\x80"), "€", "ok"),
    # codec look-up ignores punctuation, so the quotes do no harm
    "quoted charset": (record(b'Content-Type: a; charset="latin-1"', b"\xe9"), "é", "ok"),
    "trailing parameter": (record(b"Content-Type: a; charset=latin-1; q=1", "é".encode()), "é", "ok"),
    "second line": (record(b"Content-Type: a\r\nContent-Type: b; charset=latin-1", b"\xe9"), "é", "ok"),
    "codec, no charset": (record(b"Content-Type: a; charset=base64", b"eA=="), "eA==", "ok"),
    "bad bytes": (record(b"X: y", b"a\xffb"), "a�b", "ok"),
    "shift_jis": (record(b"Content-Type: a; charset=shift_jis", "日本".encode("shift_jis")), "日本", "ok"),
    "chunked": (record(b"Transfer-Encoding: chunked", b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\nzz"), "abcde", "ok"),
    "chunked, blank line": (record(b"transfer-encoding: CHUNKED", b"\r\n3\r\nabc\r\n\r\n1\r\nd\r\n"), "abcd", "ok"),
    "chunked, short": (record(b"Transfer-Encoding: chunked", b"ff\r\nabc"), "abc", "ok"),
    "chunked, bad size": (record(b"Transfer-Encoding: chunked", b"2\r\nab\r\nzz\r\ncd"), "ab", "ok"),
    "chunked, negative": (record(b"Transfer-Encoding: chunked", b"2\r\nab\r\n-5\r\ncd"), "ab", "ok"),
    "longer header name": (record(b"X-Transfer-Encoding: chunked", b"<p>"), None, "failed"),
    "missing": (None, None, "failed"),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(name, None if raw is None else bytearray(raw)) for name, (raw, _, _) in CASES.items()]
    return {r["domain"]: r for r in rec.decode_records(spark.createDataFrame(rows, "domain string, content binary")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_decoding(decoded, name):
    _, html, status = CASES[name]
    row = decoded[name]
    assert (row["html"], row["status"]) == (html, status)
    assert row["size"] == (len(html) if html else None)
    assert (row["error"] is not None) == (status == "error")


def test_headers_as_columns_equal_the_decoder(spark, decoded):
    rows = [(name, None if raw is None else bytearray(raw)) for name, (raw, _, _) in CASES.items()]
    records = spark.createDataFrame(rows, "domain string, content binary")
    for anchored in (False, True):
        python = {r["domain"]: r for r in rec.decode_records(records, anchored=anchored).collect()}
        found = {r["domain"]: r for r in rec.response_headers(rec.unpack_records(records), anchored).collect()}
        assert {d: (r["charset"], r["chunked"]) for d, r in found.items()} == {
            d: (r["charset"], r["chunked"]) for d, r in python.items()
        }
        assert python["longer header name"]["chunked"] is not anchored
        assert python["longer header name"]["html"] == ("<p>" if anchored else None)
    assert found["second line"]["headers"]["content-type"] == [" a\r", " b; charset=latin-1"]


def test_anchored_takes_the_last_coding(spark):
    heads = {
        b"Transfer-Encoding:chunked": True, b"transfer-encoding:  gzip , Chunked ": True, b"Transfer-Encoding: chunked, gzip": False,
        b"X-Transfer-Encoding: chunked": False, b"Transfer-Encoding: chunked;x": False, b"A: transfer-encoding: chunked": False,
        b"Transfer-Encoding: gzip\r\nTransfer-Encoding: chunked": True, b"A: b": False,
    }
    rows = [(h.decode(), bytearray(record(h, b"1\r\nx\r\n0\r\n"))) for h in heads]
    records = spark.createDataFrame(rows, "domain string, content binary")
    want = {h.decode(): chunked for h, chunked in heads.items()}
    native = rec.response_headers(rec.unpack_records(records), anchored=True).collect()
    assert {r["domain"]: r["chunked"] for r in native} == want
    assert {r["domain"]: r["chunked"] for r in rec.decode_records(records, anchored=True).collect()} == want


def test_a_record_that_unpacks_to_too_much_is_an_error(spark):
    """Two megabytes that unpack to two gigabytes, beside a record at the limit."""
    bomb = gzip.compress(bytes(1 << 20), 9) * 2048
    assert len(bomb) < 4 << 20
    plain = record(b"X: y", b"z" * 5000)
    rows = [("bomb", bytearray(bomb)), ("fits", bytearray(gzip.compress(plain))), ("raw", bytearray(plain))]
    records = spark.createDataFrame(rows, "domain string, content binary")
    found = {r["domain"]: r for r in rec.decode_records(records, limit=len(plain)).collect()}
    assert {d: r["status"] for d, r in found.items()} == {"bomb": "error", "fits": "ok", "raw": "ok"}
    assert "more than" in found["bomb"]["error"]
    assert rec.decode_records(records.where("domain = 'bomb'")).first()["status"] == "error"
    short = rec.decode_records(records, limit=len(plain) - 1).where("domain = 'fits'").first()
    assert short["status"] == "error"
    assert rec.unpack_records(records, len(plain)).where("content is null").count() == 1


def test_charset_column(decoded):
    assert decoded["plain"]["charset"] == "utf-8"
    assert decoded["last charset"]["charset"] == "windows-1252"
    assert decoded["quoted charset"]["charset"] == '"latin-1"'


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    index = []
    for name in ("a.warc.gz", "b.warc.gz"):
        content = b""
        for i in range(40):
            member = gzip.compress(record(b"X: y", f"<p>{name} {i}".encode()))
            index.append((f"{name}-{i}", name, len(content), len(member)))
            content += member
        (root / name).write_bytes(content)
    index.append(("gone", "c.warc.gz", 0, 10))
    return root, index


SCHEMA = "domain string, filename string, offset bigint, length bigint"


def test_range_reads_equal_slices(spark, archives):
    root, index = archives
    rows = spark.createDataFrame(index, SCHEMA)
    table = spark.read.format("binaryFile").load(str(root)).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), "content"
    )
    sliced = {r["domain"]: r["content"] for r in rec.slice_records(rows, table).collect()}
    read = {r["domain"]: r["content"] for r in rec.read_records(rows, str(root)).collect()}
    assert read.pop("gone") is None and sliced.pop("gone") is None
    assert read == sliced and len(sliced) == 80


def brute_slice(content, offset, length):
    if content is None or offset is None or length is None or offset < 0 or length < 0 or offset >= max(1, len(content)):
        return None
    return content[offset : offset + length]


@pytest.mark.parametrize("block", [7, 64, 1 << 22])
def test_block_join_equals_slices(spark, block):
    contents = {"a": bytes(range(256)) * 3, "b": b"short", "c": b"", "d": b"x" * 64, "e": b"y" * 65}
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")
    rows = [
        (f"{name}{o}+{n}", name, o, n)
        for name in [*contents, "gone"]
        for o in (0, 1, 6, 7, 63, 64, 200, 767, 768, 5000)
        for n in (0, 1, 7, 8, 64, 130, 768, 2000)
    ]
    rows += rows[:200] + [("n", None, 0, 1), ("o", "a", None, 1), ("l", "a", 0, None), ("-o", "a", -1, 5), ("-l", "a", 3, -1)]
    found = rec.slice_records(spark.createDataFrame(rows, SCHEMA).repartition(3), table, block)
    assert found.columns == ["domain", "filename", "offset", "length", "content"]
    got = sorted(((*r[:4], None if r[4] is None else bytes(r[4])) for r in found.collect()), key=str)
    want = sorted(((*r, brute_slice(contents.get(r[1]), r[2], r[3])) for r in rows), key=str)
    assert got == want


def test_a_large_archive_is_no_hot_key(spark):
    """One archive of 10,000 records: no key of the join holds more rows than fit into a block."""
    index = spark.range(10_000).select(
        F.concat(F.lit("d"), "id").alias("domain"), F.lit("one").alias("filename"),
        (F.col("id") * 100).alias("offset"), F.lit(100).cast("bigint").alias("length"),
    )
    table = spark.createDataFrame([("one", bytearray(b"0123456789" * 100_000))], "path string, content binary")
    pieces = rec._block_pieces(index, 4096)
    most = pieces.groupBy("filename", "__block").count().agg(F.max("count")).first()[0]
    assert most <= 4096 // 100 + 2
    blocks = rec.archive_blocks(table, 4096)
    assert blocks.agg(F.max(F.octet_length("bytes")), F.count("*")).first() == (4096, 245)
    sliced = rec.slice_records(index, table, 4096)
    assert sliced.where("content = cast(repeat('0123456789', 10) as binary)").count() == 10_000


def test_fetch_in_one_pass(spark, archives):
    root, index = archives
    log = rec.fetch_pages(spark.createDataFrame(index, SCHEMA), str(root))
    assert tuple(rec.fetch_counts(log).first()) == (80, 1)
    assert log.where("domain = 'b.warc.gz-7'").first()["html"] == "<p>b.warc.gz 7"


def test_one_archive_is_read_by_many_tasks(spark):
    index = spark.range(400).select(
        F.lit("x").alias("domain"), F.lit("one").alias("filename"),
        (F.col("id") * rec.REGION_BYTES).alias("offset"), F.lit(1).cast("bigint").alias("length"),
    )
    assert rec._by_region(index, rec.fetch_tasks(index.withColumn('length', F.lit(rec.REGION_BYTES)))).select(F.spark_partition_id()).distinct().count() > 1


def test_bad_ranges_are_error_rows(spark, archives):
    root, _ = archives
    bad = [("null", "a.warc.gz", None, 5), ("before", "a.warc.gz", -1, 5), ("size", "a.warc.gz", 0, -5), ("name", None, 0, 5)]
    rows = spark.createDataFrame([*bad, ("gone", "none.gz", 0, 5)], SCHEMA)
    fetched = rec.fetch_pages(rows, str(root), tasks=2).collect()
    assert {(r["status"], r["html"]) for r in fetched} == {("error", None)} and all(r["error"] for r in fetched)
    assert {r["content"] for r in rec.read_records(rows, str(root)).collect()} == {None}


def test_batches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(rec, "BATCH_BYTES", 1000)
    batch = pa.RecordBatch.from_pylist([{"content": record(b"X: y", b"z" * n)} for n in (300, 300, 300, 300, 5000, 10)])
    out = list(rec._outcomes([batch], [], rec._DECODED_TYPES, lambda row: rec._guarded(lambda: row["content"])))
    assert sum(b.num_rows for b in out) == 6 and len(out) >= 3
    assert all(sum(b.column("size").to_pylist()[:-1]) < 1000 for b in out)


def test_a_step_holds_one_input_batch_and_little_output():
    before, most, megabyte = pa.total_allocated_bytes(), [0, 0], 1 << 20

    def held():
        return (pa.total_allocated_bytes() - before) / megabyte

    def batches():
        for _ in range(4):
            most[0] = max(most[0], held())
            yield pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([b"z" * megabyte] * 40)], ["id", "content"])

    kinds, rows = {"content": pa.binary()}, 0
    for out in rec._outcomes(batches(), ["id"], kinds, lambda row: rec._unpacked_content(row, rec.UNPACKED_LIMIT)):
        most[1], rows = max(most[1], held()), rows + out.num_rows
    assert rows == 160 and most[0] < 20 and most[1] < 40 + 30


def test_resume_uses_the_safe_name(spark):
    index = spark.createDataFrame([("a/b:c",), ("d",)], "domain string")
    done = spark.createDataFrame([("a_b_c",)], "domain string")
    assert [r["domain"] for r in rec.resume_pending(index, done).collect()] == ["d"]


def test_page_files(spark, tmp_path):
    (tmp_path / "a b+c%41.html").write_bytes(b"x\xffy")
    (tmp_path / "skip.txt").write_bytes(b"no")
    assert [tuple(r) for r in scan_pages(spark, str(tmp_path)).collect()] == [("a b+c%41", "x�y")]

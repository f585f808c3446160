"""ARC to WARC: parsing of both versions, round trips, revisits."""

import gzip
import hashlib

import pytest

from huescope.llm import warc

SCHEMA = "page_id long, url string, html string, HTML string, record string"
HTML = "<p>" + "long enough to be referred to " * 5 + "</p>"
ROWS = [
    (5, "http://a.example/x y", HTML), (3, "http://b.example/", HTML), (9, None, HTML), (1, "u", "short"), (2, "u", "short"),
    (4, "", None), (6, "é", ""), (7, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\n" * 30), (8, "v", "é" * 50), (10, "w", "é" * 50),
    (11, "z", "x" * 3_000_000), (12, "q", "a" * 99), (13, "q", "a" * 99), (14, "q", "b" * 100), (15, "q", "b" * 100),
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(parts)


def convert(spark, rows, folder):
    warc.write_arc(frame(spark, rows), f"{folder}/arc")
    warc.write_warc(warc.convert(warc.read_arc(spark, f"{folder}/arc")), f"{folder}/warc")
    return warc.page_records(spark, f"{folder}/warc")


def test_pages(spark, tmp_path):
    payloads = {p: (h or "").encode() for p, _, h in ROWS}
    first = {}
    for p in sorted(payloads):
        first.setdefault(payloads[p], p)
    want = []
    for p, body in payloads.items():
        again = len(body) >= 100 and first[body] != p
        digest = hashlib.sha256(body).hexdigest()
        want.append((p, len(body), digest, "revisit" if again else "response", first[body] if again else None))
    assert sorted(tuple(r) for r in convert(spark, ROWS, tmp_path).collect()) == sorted(want)


def test_repeated_and_missing_ids(spark, tmp_path):
    found = [tuple(r) for r in convert(spark, [(1, "u", HTML), (1, "u", HTML), (None, "u", HTML)], tmp_path).collect()]
    assert sorted(r[3] for r in found) == ["response", "revisit", "revisit"]
    assert {r[4] for r in found if r[3] == "revisit"} == {1}
    assert {r[0] for r in found} == {1, None}


def test_no_pages(spark, tmp_path):
    assert convert(spark, [], tmp_path).count() == 0


def test_header_lines_of_both_versions():
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\n\nworld"
        tail = b"" if version == 1 else b"200 chk - 77 file.arc "
        line = b"http://x.example/ 1.2.3.4 19990102030405 text/html " + tail + b"%d\n" % len(body)
        content = warc.version_block(version) + b"\n" + line + body + b"\n" + line + body + b"\n"
        for data in (content, gzip.compress(content), gzip.compress(content[:200]) + gzip.compress(content[200:])):
            records = list(warc.parse_arc(data))
            assert [r["url"].split(":")[0] for r in records] == ["filedesc", "http", "http"]
            assert [r["block"] for r in records[1:]] == [body, body]
            assert content[records[2]["start"] :].startswith(line)


def test_a_line_without_length_ends_the_file():
    content = warc.version_block(1) + b"\nhttp://x 0 1 t nonsense\nrest"
    first, fault = warc.parse_arc(content)
    assert "error" not in first and fault["error"] == "http://x 0 1 t nonsense"


def test_a_damaged_archive_gives_an_error_row(spark, tmp_path):
    good = warc.arc_record(1, "http://a", "20240102030405", 7, b"payload")
    (tmp_path / "whole.arc").write_bytes(warc.version_block(1) + b"\n" + good)
    (tmp_path / "damaged.arc").write_bytes(warc.version_block(1) + b"\n" + good + b"\nhttp://x 0 1 t nonsense\n" + good)
    rows = warc.read_arc(spark, str(tmp_path))
    faults = rows.where("kind = 'error'").collect()
    assert [r["type"] for r in faults] == ["http://x 0 1 t nonsense"] and faults[0]["url"].startswith("damaged.arc#")
    assert rows.where("kind = 'response'").count() == 2
    assert sorted(r["kind"] for r in warc.convert(rows).collect()) == ["response", "response", "warcinfo", "warcinfo"]


def test_payloads_are_not_joined_by_digest(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", HTML) for i in range(50)], "page_id long, url string, html string")
    warc.write_arc(rows, str(tmp_path / "arc"))
    found = warc.revisits(warc.read_arc(spark, str(tmp_path / "arc")))
    assert found.columns == ["record_id", "first"] and found.count() == 49
    assert {r["first"]["page_id"] for r in found.collect()} == {0}


def test_archives_are_written_in_bounded_batches(spark, tmp_path, monkeypatch):
    rows = spark.range(300, numPartitions=1).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 400000) AS html")
    warc.write_arc(rows, str(tmp_path / "arc"))
    assert warc.read_arc(spark, str(tmp_path / "arc")).where("kind = 'response' and payload_bytes = 400000").count() == 300


def test_other_schemes_become_resources(spark, tmp_path):
    body = b"20240101 1.2.3.4"
    line = b"dns:x.example 1.2.3.4 20240101000000 text/dns %d\n" % len(body)
    (tmp_path / "one.arc").write_bytes(warc.version_block(1) + b"\n" + line + body + b"\n")
    rows = warc.convert(warc.read_arc(spark, str(tmp_path))).collect()
    assert sorted(r["kind"] for r in rows) == ["resource", "warcinfo"]
    record = next(bytes(r["record"]) for r in rows if r["kind"] == "resource")
    head, block = next(warc.parse_warc(record + b"\r\n\r\n"))
    assert block == body and b"WARC-Date: 2024-01-01T00:00:00Z" in head and b"urn:uuid:" in head


@pytest.mark.parametrize("digits, want", [("19990102030405", "1999-01-02T03:04:05Z"), ("1999", "1999-01-01T00:00:00Z")])
def test_dates(digits, want):
    assert warc.iso_date(digits) == want

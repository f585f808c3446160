"""A stopped fetch goes on with what no step has committed."""

import gzip

import pytest

from huescope.operators import records
from huescope.plans import fetch

SCHEMA = "domain string, filename string, offset bigint, length bigint"
HEAD = b"WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n"


@pytest.fixture()
def archives(tmp_path):
    index = []
    for n in range(6):
        content = b""
        for i in range(10):
            member = gzip.compress(HEAD + f"<p>{n} {i}".encode())
            index.append((f"site{n}-{i}", f"a{n}.gz", len(content), len(member)))
            content += member
        (tmp_path / f"a{n}.gz").write_bytes(content)
    return tmp_path, index


def test_only_uncommitted_steps_are_read_again(spark, archives, tmp_path, monkeypatch):
    root, rows = archives
    index, store = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "store")
    whole, taken = records.fetch_pages, []

    def stops_later(planned, *more):
        names = {r["filename"] for r in planned.select("filename").distinct().collect()}
        if sum(map(bool, taken)) == 3 and names:
            raise RuntimeError("executor lost")
        taken.append(names)
        return whole(planned, *more)

    monkeypatch.setattr(records, "fetch_pages", stops_later)
    size = sum(r[3] for r in rows) // 6
    with pytest.raises(Exception, match="executor lost"):
        fetch.resume_fetch(index, str(root), store, step_files=1, file_bytes=size)
    before = {r["domain"]: r["html"] for r in fetch.scan_fetched(index, store).collect()}
    committed = set().union(*taken)
    assert 0 < len(before) < len(rows)

    # the committed regions are gone: reading them again would give errors
    pending = {r[1] for r in rows if r[0] not in before}
    for name in committed - pending:
        (root / name).unlink()
    taken.clear()
    monkeypatch.setattr(records, "fetch_pages", lambda planned, *more: taken.append(planned.count()) or whole(planned, *more))
    after = fetch.resume_fetch(index, str(root), store, step_files=1, file_bytes=size).collect()
    assert sum(taken) == len(rows) - len(before)
    assert len(after) == len(rows) and {r["status"] for r in after} == {"ok"}
    assert all(r["html"] == before.get(r["domain"], r["html"]) for r in after)


def test_a_half_written_step_is_written_anew(spark, archives, tmp_path, monkeypatch):
    root, rows = archives
    index, store = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "store")
    whole = records.fetch_pages

    class Dies:
        """Writes its step, then fails before the step is committed."""

        def __init__(self, rows):
            self.rows, self.write = rows, self

        def mode(self, name):
            return self

        def parquet(self, path):
            self.rows.write.mode("overwrite").parquet(path)
            if self.rows.count():
                raise RuntimeError("driver lost")

    monkeypatch.setattr(records, "fetch_pages", lambda planned, *more: Dies(whole(planned, *more)))
    with pytest.raises(Exception, match="driver lost"):
        fetch.resume_fetch(index, str(root), store)
    monkeypatch.setattr(records, "fetch_pages", whole)
    found = fetch.resume_fetch(index, str(root), store)
    assert found.count() == len(rows) == fetch.stored_pages(found).distinct().count()


def test_new_rows_and_failed_ones_are_asked_for_again(spark, archives, tmp_path):
    root, rows = archives
    store = str(tmp_path / "store")
    hidden = (root / "a2.gz").rename(root / "hidden.gz")
    first = fetch.resume_fetch(spark.createDataFrame(rows[:40], SCHEMA), str(root), store)
    assert fetch.latest_outcomes(first).where("status = 'error'").count() == 10
    hidden.rename(root / "a2.gz")
    index = spark.createDataFrame(rows, SCHEMA)
    second = fetch.resume_fetch(index, str(root), store)
    log = fetch.latest_outcomes(second).collect()
    assert len(log) == 60 and {r["status"] for r in log} == {"ok"}
    assert sum(r["attempts"] for r in log) == 70 == second.count()
    third = fetch.resume_fetch(index, str(root), store)  # nothing is pending
    assert third.count() == 70
    assert fetch.stored_pages(third).count() == 60


def test_nothing_to_fetch(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert fetch.resume_fetch(none, str(tmp_path), str(tmp_path / "store")).collect() == []
    assert fetch.resume_fetch(none, str(tmp_path), str(tmp_path / "store")).collect() == []

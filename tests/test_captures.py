import contextlib
import io
import re

from pyspark.sql import functions as F

from huescope.operators import captures as cap
from huescope.plans.lookup import import_captures, lookup_homepages
from huescope.sources import index as idx


def captures(spark, n=6000):
    """A third of all rows belongs to hot.example; best captures are known."""
    i = F.col("id")
    domain = F.when(i % 3 == 0, F.lit("hot.example")).otherwise(F.concat(F.lit("d"), i % 100, F.lit(".example")))
    return spark.range(n).select(
        F.concat(F.lit("https://"), domain, F.lit("/?"), i).alias("url"),
        domain.alias("url_host_registered_domain"),
        F.concat(F.when(i % 5 < 3, "blog.").when(i % 5 == 3, "www.").otherwise(""), domain).alias("url_host_name"),
        F.when(i % 2 == 0, "https").otherwise("http").alias("url_protocol"),
        F.lit("/").alias("url_path"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + i % 50 * 1_000_000).alias("fetch_time"),
        F.lit(200).cast("smallint").alias("fetch_status"),
        F.lit("text/html").alias("content_mime_detected"),
        F.concat(F.lit("D"), i).alias("content_digest"),
        F.lit("f").alias("warc_filename"),
        i.cast("int").alias("warc_record_offset"),
        F.lit(9).alias("warc_record_length"),
        F.lit("C").alias("crawl"),
        F.lit("warc").alias("subset"),
    )


def expected(rows, listed):
    best = {}
    for r in rows:
        d = r["url_host_registered_domain"]
        rank = (
            r["url_host_name"] not in (d, f"www.{d}"),
            r["url_protocol"] != "https",
            -r["fetch_time"].timestamp(),
            r["url"],
        )
        if d in listed and (d not in best or rank < best[d][0]):
            best[d] = (rank, r["url"])
    return {d: url for d, (_, url) in best.items()}


def test_lookup_by_broadcast_and_by_shuffle(spark):
    rows = captures(spark)
    listed = ["hot.example", "d1.example", "d7.example", "none.example"]
    domains = spark.createDataFrame([(i, d) for i, d in enumerate(listed)], "rank int, domain string")
    want = expected(rows.collect(), set(listed)) | {"none.example": None}
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            index = lookup_homepages(rows, domains, "C").collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r["domain"]: r["url"] for r in index} == want and len(index) == 4
        assert {r["status"] for r in index if r["url"] is None} == {"not_found"}


def test_a_long_list_is_not_broadcast(spark):
    rows = captures(spark)
    domains = spark.createDataFrame([(1, "hot.example"), (2, "d1.example"), (3, "none.example")], "rank int, domain string")
    long = {tuple(r) for r in lookup_homepages(rows, domains, "C", long_list=True).collect()}
    assert long == {tuple(r) for r in lookup_homepages(rows, domains, "C").collect()}
    picked = cap.filter_domain_in(cap.pick_homepage(rows), domains.hint("merge"))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_time_is_text_in_utc(spark):
    micros = {
        1_769_904_000_120_000: "2026-02-01 00:00:00.120",
        1_772_937_000_000_000: "2026-03-08 02:30:00.000",  # an hour that New York's clocks skip
        1_772_935_200_999_000: "2026-03-08 02:00:00.999",
        -1_000: "1969-12-31 23:59:59.999",
    }
    df = spark.createDataFrame([(m,) for m in micros], "m bigint").select("m", F.timestamp_micros("m").alias("t"))
    for zone in ("UTC", "America/New_York", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r[0]: r[1] for r in df.select("m", cap.utc_text(F.col("t"))).collect()} == micros
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_import_defaults_fill_absent_columns_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'domain,url,fetch_time,warc_filename,warc_record_offset,warc_record_length\n'
        'x.example,"https://x.example/,a",,f,5,6\nx.example,https://x.example/2,t,f,7,8\n'
    )
    domains = spark.createDataFrame([(1, "x.example"), (2, "y.example")], "rank int, domain string")
    rows = import_captures(idx.scan_capture_csv(spark, str(tmp_path / "a.csv")), domains).collect()
    assert len(rows) == 3  # found rows are not deduplicated
    first = next(r for r in rows if r["offset"] == 5)
    assert (first["url"], first["timestamp"], first["mime"], first["digest"]) == (
        "https://x.example/,a", "", "text/html", "",
    )
    assert [r["domain"] for r in rows if r["status"] == "not_found"] == ["y.example"]


def test_index_json_array_file(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"status": "found", "domain": "a", "offset": 3},\n {"status": "not_found", "domain": "b"}]')
    rows = idx.scan_index_json(spark, str(tmp_path / "i.json"), array_file=True).collect()
    assert [(r["domain"], r["offset"]) for r in rows] == [("a", 3), ("b", None)]


def test_index_scan_prunes_and_pushes_down(spark, tmp_path):
    captures(spark).write.partitionBy("crawl", "subset").parquet(str(tmp_path / "index"))
    df = cap.filter_homepage_captures(idx.scan_capture_index(spark, str(tmp_path / "index")), "C")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        cap.project_captures(df).explain("formatted")
    plan = out.getvalue()
    assert re.search(r"PartitionFilters: \[.*\(crawl#\d+ = C\).*\(subset#\d+ = warc\)", plan)
    for pushed in ("EqualTo(fetch_status,200)", "EqualTo(url_path,/)", "EqualTo(content_mime_detected,text/html)"):
        assert pushed in plan
    assert "url_surtkey" not in plan.split("ReadSchema")[1]


def test_counts(spark):
    index = spark.createDataFrame([("found",), ("found",), ("not_found",)], "status string")
    domains = spark.range(7).select(F.col("id").cast("string").alias("domain"))
    assert tuple(cap.lookup_counts(index, domains).first()) == (2, 1, 7)


def test_buckets_serve_pick_and_list_without_a_shuffle(spark, tmp_path):
    rows = captures(spark)
    listed = ["hot.example", "d1.example", "d7.example", "none.example"]
    domains = spark.createDataFrame([(i, d) for i, d in enumerate(listed)], "rank int, domain string")
    for name in ("test_captures_by_domain", "test_domains_by_domain"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    table = idx.bucket_captures(rows, "test_captures_by_domain", str(tmp_path / "c"), 6)
    listing = idx.bucket_domains(domains, "test_domains_by_domain", str(tmp_path / "d"), 6)
    picked = cap.pick_homepage(cap.filter_homepage_captures(table, "C"))
    joined = cap.filter_domain_in(picked, listing.hint("merge"))
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "SortMergeJoin" in text and "PartitionFilters: [isnotnull(crawl" in text
    want = expected(rows.collect(), set(listed))
    assert {r["url_host_registered_domain"]: r["url"] for r in joined.collect()} == want
    whole = lookup_homepages(table, listing, "C", long_list=True).collect()
    assert {r["domain"]: r["url"] for r in whole} == want | {"none.example": None} and len(whole) == 4
    for name in ("test_captures_by_domain", "test_domains_by_domain"):
        spark.sql(f"DROP TABLE {name}")

"""Capture index to one homepage capture per listed domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_homepage_captures(captures: DataFrame, crawl: str) -> DataFrame:
    """Successful HTML homepages of one crawl.

    crawl and subset prune partitions, the rest reaches the Parquet scan.
    """
    return captures.where(
        (F.col("crawl") == crawl)
        & (F.col("subset") == "warc")
        & (F.col("fetch_status") == 200)
        & (F.col("url_path") == "/")
        & (F.col("content_mime_detected") == "text/html")
    )


def filter_domain_in(captures: DataFrame, domains: DataFrame) -> DataFrame:
    """Keep captures of the listed domains: a semi join, broadcast below Spark's threshold.

    A list too long for that is better joined after ``pick_homepage``: the filter is
    on the key of that pick, so the rows are the same and one per domain is left.
    """
    listed = domains.select(F.col("domain").alias("url_host_registered_domain"))
    return captures.join(listed, "url_host_registered_domain", "left_semi")


def pick_homepage(captures: DataFrame) -> DataFrame:
    """One capture per registered domain: bare or www host, https, most recent.

    Ties go to the smallest url, then to the first record of the archive. The
    window's group limit leaves one row per domain and task before the shuffle.
    """
    domain, host = F.col("url_host_registered_domain"), F.col("url_host_name")
    main_host = (host == domain) | (host == F.concat(F.lit("www."), domain))
    best = Window.partitionBy("url_host_registered_domain").orderBy(
        F.when(main_host, 0).otherwise(1),
        F.when(F.col("url_protocol") == "https", 0).otherwise(1),
        F.col("fetch_time").desc(),
        "url",
        "warc_filename",
        "warc_record_offset",
    )
    return captures.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def utc_text(time: Column) -> Column:
    """Timestamp as text with milliseconds, in UTC whatever the session's zone.

    Counted from the epoch without a zone, since a local clock skips hours.
    """
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    clock = (epoch + F.expr("INTERVAL '1' SECOND") * F.unix_seconds(time)).cast("string")
    millis = F.lpad(F.pmod(F.unix_millis(time), F.lit(1000)).cast("string"), 3, "0")
    return F.concat(clock, F.lit("."), millis)


def project_captures(captures: DataFrame) -> DataFrame:
    """The eight columns of a lookup row; fetch_time as text."""
    return captures.select(
        F.col("url_host_registered_domain").alias("domain"),
        "url",
        utc_text(F.col("fetch_time")).alias("fetch_time"),
        "warc_filename",
        "warc_record_offset",
        "warc_record_length",
        "content_mime_detected",
        "content_digest",
    )


def normalise_captures(rows: DataFrame) -> DataFrame:
    """Lookup rows to found index rows; a default fills an absent column only."""

    def column_or(name: str, default: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(default)

    return rows.select(
        F.lit("found").alias("status"),
        "domain",
        "url",
        column_or("fetch_time", "").alias("timestamp"),
        F.col("warc_filename").alias("filename"),
        F.col("warc_record_offset").cast("bigint").alias("offset"),
        F.col("warc_record_length").cast("bigint").alias("length"),
        column_or("content_mime_detected", "text/html").alias("mime"),
        column_or("content_digest", "").alias("digest"),
    )


def mark_not_found(found: DataFrame, domains: DataFrame) -> DataFrame:
    """Append a ``not_found`` row for each listed domain without a capture.

    Only the distinct found domains travel to the anti join, so repeated rows
    of one domain do not meet in one task.
    """
    missing = domains.select("domain").join(found.select("domain").distinct(), "domain", "left_anti")
    return found.unionByName(
        missing.select(F.lit("not_found").alias("status"), "domain"), allowMissingColumns=True
    )


def filter_found(index: DataFrame) -> DataFrame:
    return index.where(F.col("status") == "found")


def lookup_counts(index: DataFrame, domains: DataFrame) -> DataFrame:
    """(found, not_found, listed) as one row."""
    counts = index.select(
        (F.col("status") == "found").cast("bigint").alias("found"),
        (F.col("status") == "not_found").cast("bigint").alias("not_found"),
        F.lit(0).cast("bigint").alias("listed"),
    )
    listed = domains.select(
        F.lit(0).cast("bigint").alias("found"),
        F.lit(0).cast("bigint").alias("not_found"),
        F.lit(1).cast("bigint").alias("listed"),
    )
    return counts.unionByName(listed).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "not_found", "listed")]
    )

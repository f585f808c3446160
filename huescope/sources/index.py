"""Domain list and capture index: scans, table registration, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope import schemas


def scan_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(rank, domain) of a header CSV; ``rank`` keeps the file's order."""
    return spark.read.csv(path, header=True, schema=schemas.DOMAINS)


def scan_capture_index(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet index under ``root``; crawl and subset come from the folders."""
    return spark.read.schema(schemas.capture_schema()).parquet(root)


def register_capture_table(
    spark: SparkSession, table: str, root: str, crawl: str | None = None
) -> DataFrame:
    """Catalog table over the index: every partition, or one crawl's only."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schemas.capture_schema()}) "
        f"USING parquet PARTITIONED BY (crawl, subset) LOCATION '{root}'"
    )
    if crawl is None:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    else:
        spark.sql(
            f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (crawl = '{crawl}', subset = 'warc') "
            f"LOCATION '{root.rstrip('/')}/crawl={crawl}/subset=warc'"
        )
    return spark.table(table)


def bucket_captures(captures: DataFrame, table: str, root: str, buckets: int) -> DataFrame:
    """Catalog table of captures under ``root``, bucketed by registered domain within crawl and subset.

    Paid once per crawl: a pick per domain and a join with a list that is bucketed
    alike then read matching buckets and shuffle nothing. Rows lie by domain and
    path, so a scan for homepages skips most of a domain with many captures. A
    bucket is read by one task; for a crawl with a domain of more captures than
    that bears, the plain table is the better one.
    """
    key = "url_host_registered_domain"
    rows = captures.repartition(buckets, key)
    writer = rows.write.mode("overwrite").partitionBy("crawl", "subset").bucketBy(buckets, key)
    writer.sortBy(key, "url_path").option("path", root).format("parquet").saveAsTable(table)
    return captures.sparkSession.table(table)


def bucket_domains(domains: DataFrame, table: str, root: str, buckets: int) -> DataFrame:
    """Catalog table of a domain list under ``root``, bucketed as captures are."""
    writer = domains.repartition(buckets, "domain").write.mode("overwrite").bucketBy(buckets, "domain")
    writer.sortBy("domain").option("path", root).format("parquet").saveAsTable(table)
    return domains.sparkSession.table(table)


def scan_capture_csv(spark: SparkSession, path: str, line_ends_in_cells: bool = True) -> DataFrame:
    """Rows of a query-result CSV by header name, all text; an empty cell is the empty text.

    Cells may hold line ends, so a file is read by one task; without such cells, say
    so and large files are split.
    """
    rows = spark.read.csv(path, header=True, multiLine=line_ends_in_cells, escape='"')
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def write_index_json(results: DataFrame, path: str) -> None:
    results.write.json(path)


def scan_index_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Lookup rows; ``array_file`` reads a file that holds one JSON array."""
    return spark.read.schema(schemas.INDEX_RESULTS).json(path, multiLine=array_file)

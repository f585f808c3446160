"""Page text, as a table or as a folder of ``<name>.html`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope import schemas
from huescope.functions.text import newlines


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, html) of every ``*.html`` file; invalid UTF-8 becomes U+FFFD, line ends line feeds."""
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.html")
    return files.select(
        F.regexp_extract(F.col("path"), r"([^/]*)\.html$", 1).alias("domain"),
        newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("html"),
    )


def safe_name(domain):
    """Key of a page's output: the domain without path and port separators."""
    return F.translate(domain, "/:", "__")


def write_pages(pages: DataFrame, path: str) -> None:
    """Store the pages that have text, one for each domain.

    Of several pages of a domain the greatest text stays, so the result does not
    depend on their order; each task keeps one candidate before the shuffle.
    """
    best = pages.where(F.length("html") > 0).groupBy("domain").agg(F.max("html").alias("html"))
    best.write.parquet(path)


def write_fetch_log(log: DataFrame, path: str) -> None:
    log.select("domain", "status", "size", "error").write.json(path)


def scan_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCH_LOG).json(path)

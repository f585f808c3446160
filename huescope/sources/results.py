"""Result, summary and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huescope import schemas


def project_results_compact(results: DataFrame) -> DataFrame:
    """All fields but the pairings."""
    return results.drop("pairings")


def write_results(results: DataFrame, path: str) -> None:
    """Compact results: page statistics and the worst pairings."""
    project_results_compact(results).write.json(path)


def write_results_full(results: DataFrame, path: str) -> None:
    """Results with every pairing nested in its page."""
    results.drop("worst_pairings").write.json(path)


def scan_results(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    schema = schemas.RESULTS_FULL if full else schemas.RESULTS
    return spark.read.schema(schema).json(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """The one-row summary as one nested JSON object."""
    summary.write.json(path)


def write_report_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """The report with a header, each file by rank; ``single_file`` for a result known to be small.

    Ranking has sorted and stored the rows, so they are written from where they
    lie: a file's ranks ascend, and nothing is shuffled again.
    """
    placed = report.coalesce(1) if single_file else report
    placed.sortWithinPartitions("rank").write.csv(path, header=True)


def scan_report_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.REPORT)

"""Fetch that commits step by step and goes on where it stopped.

A store is a folder with three parts:

- ``plan``: index rows, neighbouring records in one file of about
  ``PLAN_FILE_BYTES`` of record bytes. Appending to it asks for more records.
- ``fetched/step=n``: what one step read and decoded, written by that step alone.
- ``progress``: the checkpoint of a file stream over ``plan``.

A run is a stream that ends when the plan is used up. Each step takes the next
plan files, fetches their records and overwrites its own ``step`` folder; then the
checkpoint moves on. After a crash the stream repeats only the step that was not
committed, into the same folder, so nothing is read twice that was committed and
nothing is listed twice. A step has many regions, so all executors share it; how
much a crash may cost is the parameter ``step_files``.

Records that failed are asked for again by the next call, like pages that were
never stored. Every attempt stays listed; ``latest_outcomes`` picks the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.operators import records
from huescope.operators.records import DECODED, resume_pending

#: Record bytes of a plan file, and plan files of a step.
PLAN_FILE_BYTES = 1 << 30
STEP_FILES = 64

_IDENTITY = ("domain", "filename", "offset", "length")


def _schema(index: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)


def plan_fetch(index: DataFrame, store: str, file_bytes: int = PLAN_FILE_BYTES) -> None:
    """Append index rows to the plan, in archive order, a file for every ``file_bytes`` of records."""
    total = index.agg(F.sum(F.greatest(F.col("length"), F.lit(0)))).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    spread = index.repartitionByRange(files, "filename", "offset").sortWithinPartitions("filename", "offset")
    spread.write.mode("append").parquet(f"{store}/plan")


def run_fetch(index: DataFrame, archive_root: str, store: str, step_files: int = STEP_FILES, **decoding) -> None:
    """Fetch what the plan asks for and no step has committed; of ``index`` only the columns count.

    ``decoding`` goes to ``fetch_pages``.
    """
    spark = index.sparkSession
    index.limit(0).write.mode("ignore").parquet(f"{store}/plan")

    def step(planned: DataFrame, number: int) -> None:
        fetched = records.fetch_pages(planned, archive_root, **decoding)
        fetched.write.mode("overwrite").parquet(f"{store}/fetched/step={number}")

    planned = (
        spark.readStream.schema(_schema(index))
        .option("maxFilesPerTrigger", step_files)
        .option("maxFileAge", "36500d")  # a plan does not age
        .parquet(f"{store}/plan")
    )
    run = planned.writeStream.foreachBatch(step).option("checkpointLocation", f"{store}/progress")
    run.trigger(availableNow=True).start().awaitTermination()


def scan_fetched(index: DataFrame, store: str) -> DataFrame:
    """Every committed attempt: the columns of ``index``, the outcome, and the ``step`` that made it."""
    decoded = ", ".join(f"{name} {kind}" for name, (kind, _) in DECODED.items())
    schema = f"{_schema(index)}, {decoded}, step long"
    return index.sparkSession.read.schema(schema).parquet(f"{store}/fetched")


def resume_fetch(
    index: DataFrame,
    archive_root: str,
    store: str,
    step_files: int = STEP_FILES,
    file_bytes: int = PLAN_FILE_BYTES,
    **decoding,
) -> DataFrame:
    """Bring the store up to date with ``index`` and return all its attempts.

    First ends what an interrupted call had planned, then plans the rows whose
    page is not stored: new ones, and those whose record failed before. A page
    counts as stored under its safe name. An empty index fetches nothing.
    """
    run_fetch(index, archive_root, store, step_files, **decoding)
    pages = scan_fetched(index, store).where("status = 'ok'").select("domain")
    pending = resume_pending(index, pages.distinct())
    if not pending.isEmpty():
        plan_fetch(pending, store, file_bytes)
        run_fetch(index, archive_root, store, step_files, **decoding)
    return scan_fetched(index, store)


def latest_outcomes(fetched: DataFrame) -> DataFrame:
    """The fetch log: each record's outcome of its last attempt; page texts are not moved."""
    outcome = F.struct("status", "size", "error")
    last = fetched.groupBy(*_IDENTITY).agg(F.max_by(outcome, "step").alias("o"), F.count(F.lit(1)).alias("attempts"))
    return last.select(*_IDENTITY, "o.status", "o.size", "o.error", "attempts")


def stored_pages(fetched: DataFrame) -> DataFrame:
    """(domain, html) of the attempts that gave a page, for ``write_pages``."""
    return fetched.where("status = 'ok'").select("domain", "html")

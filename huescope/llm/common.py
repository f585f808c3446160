"""What the operators share: safe column choice, row batches, fixed patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope.sources.shared import fresh_path

#: Characters of text that a batch of output rows may hold.
TEXT_BYTES = 16_000_000
#: The ASCII white space that separates words, as Java and Python regular expressions read it.
SPACE = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched by exact case, first occurrence.

    Goes by position, so further columns whose names differ in case only, or are
    repeated, don't make a name ambiguous. A column that is missing raises.
    """
    places = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    if absent := [n for n in names if n not in places]:
        raise ValueError(f"columns missing: {absent}; there are {df.columns}")
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{places[n]}").alias(n) for n in names])


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; Spark's reader opens the path."""
    return pick(spark.read.parquet(f"{folder}/{name}.parquet"), *columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, read back: computed once, cheap to recover."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def arrow_map(
    df: DataFrame,
    rows: Callable[[Iterator[tuple]], Iterable[tuple]],
    schema: str,
    flush: int = 2000,
    flush_bytes: int | None = None,
) -> DataFrame:
    """Run a generator of tuples over each partition's rows, in Arrow batches.

    Input batches keep Spark's byte limit; output goes out every ``flush`` rows,
    with ``flush_bytes`` also as soon as its texts hold so many: for rows that
    carry whole texts, which few rows are turned into objects at once then.
    """
    step = 16 if flush_bytes else 512
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    yield from zip(*[c.to_pylist() for c in part.columns])

        pending: list[tuple] = []
        held = 0
        for row in rows(incoming()):
            pending.append(row)
            if flush_bytes:
                held += sum(len(v) for v in row if isinstance(v, str | bytes))
            if len(pending) >= flush or (flush_bytes and held >= flush_bytes):
                yield _batch(pending, target)
                pending, held = [], 0
        if pending:
            yield _batch(pending, target)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)]
    return pa.RecordBatch.from_arrays(columns, schema=target)

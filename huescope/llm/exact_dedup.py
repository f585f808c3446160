"""Exact deduplication over an extendible-hash index kept on shared files.

Three jobs, all DataFrame functions:

1. Owner tasks compare bytes. Grouping by hash key *and* normalised text makes
   every map task fold its own copies first, so a text with a third of all rows
   sends one row per map task; the owner of a key then compares the bytes of all
   texts with that key and keeps one chain link per different text.
2. The directory. Its slots are the leading bits of the key. It starts at the
   depth at which evenly spread links would fit, and doubles: a bucket with more
   than ``bucket_rows`` links is split by one more bit, others keep their depth.
   It is a table itself (about links / ``bucket_rows`` rows), never collected.
3. The links are range-partitioned by bucket, so each owner task holds whole,
   neighbouring buckets: a range of keys. It numbers the links that collide in
   one key and writes its range as a file of the index folder.

Members look their bucket up in the directory by the leading bits of their key,
and their link by bucket, key, digest and length; the digest belongs to one
compared text.

A key whose links cannot be told apart by more bits, or that needs more than
``MORE_BITS`` doublings, stays as an overflow chain: only the layout changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huescope.llm.common import SPACE, pick, stored, text_or_empty
from huescope.sources.shared import fresh_path

#: Doublings tried beyond the depth at which an even spread would fit.
MORE_BITS = 6
#: A directory of at most so many cells (16 bytes each) is broadcast, a larger one joined by shuffle.
BROADCAST_CELLS = 500_000


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, SPACE, " ")


def hash_key(text: Column, bits: int = 64) -> Column:
    """The leading ``bits`` bits of the text's hash, others zero (few bits force collisions)."""
    key = F.xxhash64(text)
    return key if bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def chain_links(texts: DataFrame, bits: int = 64) -> DataFrame:
    """One row per different text: key, digest, n_bytes, keep_id, group_size."""
    keyed = texts.select("doc_id", normalised(F.col("text")).alias("body"))
    grouped = (
        keyed.select("doc_id", "body", hash_key(F.col("body"), bits).alias("key"))
        .groupBy("key", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return grouped.select(
        "key",
        F.sha2(F.col("body"), 256).alias("digest"),
        F.octet_length("body").cast("long").alias("n_bytes"),
        "keep_id",
        "group_size",
    )


def directory(links: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """The directory after all doublings: cell, depth, bucket; and the cells' bits.

    A cell is a slot of the directory at full depth; cells of a bucket that was
    not split share its number, which is its leading ``depth`` bits, left-aligned.
    """
    rows = links.count()
    start = max(1, math.ceil(math.log2(max(2, rows / bucket_rows))))
    most = min(62, start + MORE_BITS)
    cells = links.groupBy(F.shiftrightunsigned("key", 64 - most).alias("cell")).agg(
        F.count(F.lit(1)).alias("links")
    )
    depth = F.lit(most)
    for bits in range(most - 1, start - 1, -1):
        slot = Window.partitionBy(F.shiftright("cell", most - bits))
        cells = cells.withColumn(f"at_{bits}", F.sum("links").over(slot))
        depth = F.when(F.col(f"at_{bits}") <= bucket_rows, F.lit(bits)).otherwise(depth)
    split = cells.select("cell", depth.alias("depth"))
    aligned = F.expr(f"shiftleft(shiftright(cell, {most} - depth), {most} - depth)")
    return split.select("cell", "depth", aligned.alias("bucket")), most


def build_index(texts: DataFrame, bucket_rows: int = 100_000, bits: int = 64) -> tuple[str, DataFrame, int]:
    """Write the index to the shared folder: its path, its directory and the cells' bits.

    ``texts`` has doc_id and text (no nulls in text). Columns: bucket, depth, key,
    chain (place among the links of a key, from 1), digest, n_bytes, keep_id,
    group_size. Files hold disjoint ranges of keys, and a bucket lies in one file.
    """
    links = stored(chain_links(texts, bits), "chain-links")
    cells, most = directory(links, bucket_rows)
    cells = stored(cells, "directory")
    placed = _with_bucket(links, cells, most)
    # the window's groups lie within a range of buckets, so it needs no further shuffle
    chain = Window.partitionBy("bucket", "key").orderBy("digest")
    owned = placed.repartitionByRange("bucket").withColumn("chain", F.row_number().over(chain))
    path = fresh_path(texts.sparkSession, "hash-index")
    (
        owned.sortWithinPartitions("bucket", F.shiftrightunsigned("key", 1), "key", "chain")
        .select("bucket", "depth", "key", "chain", "digest", "n_bytes", "keep_id", "group_size")
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return path, cells, most


def _with_bucket(keyed: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """Add bucket and depth from the directory, by the leading bits of ``key``."""
    small = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return keyed.withColumn("cell", F.shiftrightunsigned("key", 64 - most)).join(small, "cell").drop("cell")


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_rows: int = 100_000,
    bits: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation; the smallest
    id stays. Null text counts as empty, empty texts are equal to each other.
    A null id never stays unless its whole group has null ids. Of repeated rows
    with one id and equal texts exactly one is kept. Empty input gives no rows;
    further columns are ignored, whatever their names.
    """
    texts = pick(docs, id_column, text_column).toDF("doc_id", "text")
    texts = texts.select("doc_id", text_or_empty().alias("text"))
    path, cells, most = build_index(texts, bucket_rows, bits)
    index = docs.sparkSession.read.parquet(path).drop("depth")
    body = normalised(F.col("text")).alias("body")
    members = texts.select("doc_id", body).select(
        "doc_id",
        hash_key(F.col("body"), bits).alias("key"),
        F.sha2(F.col("body"), 256).alias("digest"),
        F.octet_length("body").cast("long").alias("n_bytes"),
    )
    repeat = Window.partitionBy("doc_id", "key", "digest").orderBy("n_bytes")
    members = members.withColumn("repeat", F.row_number().over(repeat))
    found = _with_bucket(members, cells, most).join(index, ["bucket", "key", "digest", "n_bytes"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)
    return found.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; see ``exact_dedup``.

    Repeated rows with one id and equal texts are one document: one of them stays.
    """
    verdict = exact_dedup(docs, id_column, text_column).where("kept")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    chosen = verdict.select(named.alias("_name"), F.col("text_sha256").alias("_digest"))
    places = [f"_c{i}" for i in range(len(docs.columns))]
    at = {n: places[i] for i, n in reversed(list(enumerate(docs.columns)))}
    digest = F.sha2(normalised(text_or_empty(at[text_column])), 256)
    own = docs.toDF(*places).withColumns(
        {"_name": F.coalesce(F.col(at[id_column]).cast("string"), F.lit("null")), "_digest": digest}
    )
    joined = own.join(chosen, ["_name", "_digest"], "left_semi")
    return joined.dropDuplicates(["_name", "_digest"]).select(*places).toDF(*docs.columns)

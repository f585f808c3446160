"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has bit ``b`` set when more than half of the XXH64
hashes of its 3-word shingles have it set. Equal fingerprints fold to one row
first, so copies cost nothing later. For the different fingerprints:

1. Distance table. The Hamming distance of each fingerprint to many references:
   zero, 32 references of two neighbouring bits each, and ``FAR`` scattered ones.
2. Candidates. Distances to the two-bit references, taken relative to the
   distance to zero, change only when one of their two bits does. Cut into
   five runs, at least three runs are equal for two fingerprints that differ in
   at most two bits; so ten keys, one for each choice of three runs, bring every
   linked pair together. Equality of keys is a shuffle, not a cross join.
3. Pivot filter. A pair whose distances to any reference differ by more than the
   limit cannot be linked (triangle inequality): discarded by the largest
   difference of coordinates over the whole table.
4. Verification of the survivors by their own Hamming distance.

Keys with more than ``DENSE`` fingerprints would emit pairs with the square of
the group, so their members take an exact way without pairs: two fingerprints
differ in at most two bits exactly when some fingerprint is within one bit of
both. Each member of a dense key names its 65 such centres, and all that name
one centre are linked to the smallest of them. No link is lost, none is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty
from huescope.llm.components import components

WORDS, LIMIT = 3, 2
#: Scattered references besides zero and the 32 of two bits.
FAR = 15
#: Keys with more fingerprints than this take the way without pairs.
DENSE = 16
PAIRS_OF_BITS = [3 << (2 * i) for i in range(32)]
#: Five runs of the 32 two-bit references.
RUNS = [range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def references() -> list[int]:
    """Zero, the two-bit references, the scattered ones, as signed 64-bit numbers."""
    scattered = [xxhash.xxh64_intdigest(f"reference {i}", seed=42) for i in range(FAR)]
    return [_signed(r) for r in [0, *PAIRS_OF_BITS, *scattered]]


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, max(0, len(words) - WORDS)
    counts, total = np.zeros(64, np.int64), last + 1
    for low in range(0, total, 4096):  # bounded memory for very long texts
        high = min(total, low + 4096)
        hashes = np.array(
            [digest(body[a : b - 1], 42) for a, b in zip(starts[low:high], [starts[min(i + WORDS, len(words))] for i in range(low, high)])],
            dtype="<u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little").view("<i8")
    return int(bits[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed long) of every document's whole text."""
    texts = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in incoming:
            yield doc_id, fingerprint(text)

    return arrow_map(texts, rows, f"doc_id {kind}, fp long")


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def distance_table(distinct: DataFrame) -> DataFrame:
    """fp, distances: Hamming distances to the references."""
    return distinct.select(
        "fp", F.array(*[hamming(F.col("fp"), F.lit(r)).cast("byte") for r in references()]).alias("distances")
    )


def candidate_keys(table: DataFrame) -> DataFrame:
    """fp, distances, key: ten keys, each from three runs of relative distances."""
    changes = [
        F.concat(*[(F.col("distances")[1 + i] - F.col("distances")[0]).cast("string") for i in run]) for run in RUNS
    ]
    runs = table.withColumns({f"run{i}": F.xxhash64(c) for i, c in enumerate(changes)})
    keys = [
        F.xxhash64(F.lit(n), *[f"run{i}" for i in three])
        for n, three in enumerate(combinations(range(len(RUNS)), len(RUNS) - LIMIT))
    ]
    return runs.select("fp", "distances", F.explode(F.array(*keys)).alias("key"))


def sparse_links(keyed: DataFrame) -> DataFrame:
    """Links between members of one key, pivot filter first, then verified."""
    left = keyed.select("key", F.col("fp").alias("u"), F.col("distances").alias("du"))
    right = keyed.select("key", F.col("fp").alias("v"), F.col("distances").alias("dv"))
    widest = F.array_max(F.zip_with("du", "dv", lambda a, b: F.abs(a - b)))
    pairs = left.join(right, "key").where("u > v").where(widest <= LIMIT)
    return pairs.where(hamming(F.col("u"), F.col("v")) <= LIMIT).select("u", "v").distinct()


def dense_links(members: DataFrame) -> DataFrame:
    """All links among ``members`` up to transitivity, through centres within one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    balls = members.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top").drop("top")
    return balls.join(least, "centre").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def near_components(prints: DataFrame) -> DataFrame:
    """fp, component_id for rows (doc_id, fp): the smallest doc_id each fingerprint reaches."""
    distinct = stored(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "fingerprints"
    )
    keyed = candidate_keys(distance_table(distinct))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(keyed.join(sizes, "key"), "pivot-keys")
    dense = shared.where(F.col("members") > DENSE).select("fp").distinct()
    links = sparse_links(shared.where(F.col("members") <= DENSE)).union(dense_links(dense))
    reached = components(links)
    grouped = distinct.join(reached, distinct.fp == reached.node, "left")
    grouped = grouped.select("fp", "least_id", F.coalesce("least", "fp").alias("root"))
    roots = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return grouped.join(roots, "root").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null text counts as empty; texts without words have fingerprint zero and are
    linked like any other. Fingerprints link at two or fewer differing bits;
    component_id is the smallest doc_id reachable, null ids aside. Repeated rows
    stay repeated. Empty input gives no rows; further columns are ignored.
    """
    prints = stored(fingerprints(docs, id_column, text_column), "prints")
    found = prints.join(near_components(prints), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the rows with the smallest id.

    Rows without an id cannot be told apart and are kept.
    """
    return keep_least(docs, simhash_dedup(docs, id_column, text_column), id_column)


def keep_least(docs: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """The rows of ``docs`` without those whose id is not its component's smallest in ``found``."""
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    places = [f"_c{i}" for i in range(len(docs.columns))]
    at = places[docs.columns.index(id_column)]
    kept = docs.toDF(*places).join(drop, F.col(at) == F.col("_drop"), "left_anti")
    return kept.toDF(*docs.columns)

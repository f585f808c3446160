"""Importance resampling of documents towards a target text collection.

Features are runs of one and two words, hashed into ``buckets``. Every task folds
its documents' features into one array of counts, so the shuffle carries at most
``buckets`` rows from each task, and the counts of the whole corpus and of the
target are two arrays of fixed size. Their log ratios, one gain per bucket, score
documents by array lookups; the mean gain plus Gumbel noise from the document's
id is its score, so the highest scores are a draw without replacement.

Which rows are drawn is found by a distributed quickselect, without sorting the
corpus. The rows' composite keys (score down, id, counts) are totally ordered. A
round takes random pivot keys from the rows that are still in question, counts
exactly how many keys lie below and at each pivot, and goes on between the two
pivots that enclose the k-th key, until a pivot is that key itself. Only counts
and pivots reach the driver. The rows up to that key, the winners, are the only
ones that are sorted and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from huescope.llm.common import arrow_map, pick, stored, text_or_empty

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Pivot keys of a quickselect round.
PIVOTS = 24
#: Bytes of a text whose words are held at once.
SEGMENT = 1 << 20

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to lower case, every other byte outside words to a blank.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def feature_hashes(text: str) -> Iterator[tuple[list[int], list[int]]]:
    """CRC-32 of the words, and of the pairs of neighbouring words, of each segment of a text."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLDED)
    begin, before, crc = 0, None, zlib.crc32
    while begin < len(folded):
        end = len(folded) if len(folded) - begin <= SEGMENT else folded.find(b" ", begin + SEGMENT)
        end = len(folded) if end < 0 else end
        words = folded[begin:end].split()
        begin = end
        if words:
            single = list(map(crc, words))
            # a pair's checksum goes on from its first word's
            first = single[:-1] if before is None else [before, *single[:-1]]
            second = words[1:] if before is None else words
            yield single, list(map(crc, [b" " + w for w in second], first))
            before = single[-1]


def _bucket_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: feature counts, folded by each task before they are shuffled."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        counts = np.zeros(buckets, np.int64)
        for (text,) in incoming:
            for hashes in feature_hashes(text):
                for some in hashes:
                    counts += np.bincount(np.array(some, dtype=np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(counts)
        yield from zip(at.tolist(), counts[at].tolist())

    return arrow_map(texts, rows, "bucket int, n long", 20_000)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often features of all ``text`` fall into each bucket: ``buckets`` numbers for the driver."""
    counts = np.zeros(buckets, np.int64)
    chosen = pick(texts, "text").select(text_or_empty().alias("text"))
    for row in _bucket_rows(chosen, buckets).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in target and source, rounded down."""
    buckets = len(source)
    of_source, of_target = float(source.sum() + buckets), float(target.sum() + buckets)
    ratios = [(t + 1.0) * of_source / ((s + 1.0) * of_target) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number from the hash of the id; a null id hashes as no digits."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document's whole text."""
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind, buckets = texts.schema["doc_id"].dataType.simpleString(), len(gain)

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in incoming:
            words = features = total = 0
            for hashes in feature_hashes(text):
                words += len(hashes[0])
                for some in hashes:
                    features += len(some)
                    total += int(gain[np.array(some, dtype=np.int64) % buckets].sum())
            weight = total // features if features else 0
            yield doc_id, words, features, weight, weight + noise(doc_id, seed)

    schema = f"doc_id {kind}, n_words long, n_features long, weight long, score long"
    return arrow_map(texts, rows, schema, 20_000)


def key_column() -> Column:
    """The composite key; rows with equal keys are equal in every column of the result."""
    return F.struct(
        (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_features", "weight"
    )


def _literal(key: Row, kind: StructType) -> Column:
    return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS) -> Row | None:
    """The k-th smallest ``key`` (from 1) of a stored frame, None if there are fewer rows.

    Every round reads the frame twice and brings at most ``pivots`` keys and two
    counts for each to the driver; whichever rows the pivots come from, the
    result is the same. Copies of one key are counted as the rows they are.
    """
    kind = keyed.schema["key"].dataType
    between, before, rounds = keyed.select("key"), 0, 0
    while True:
        chosen = between.orderBy(F.rand(rounds)).limit(pivots).collect()
        if not chosen:
            return None
        keys = sorted({r["key"] for r in chosen})
        literals = [_literal(key, kind) for key in keys]
        counts = between.agg(
            *[F.count_if(F.col("key") < p).alias(f"below{i}") for i, p in enumerate(literals)],
            *[F.count_if(F.col("key") == p).alias(f"at{i}") for i, p in enumerate(literals)],
        ).first()
        low = high = None
        for i, key in enumerate(keys):
            below, at = before + counts[f"below{i}"], counts[f"at{i}"]
            if below < k <= below + at:
                return key
            if below + at < k:
                low, passed = literals[i], below + at
            elif high is None:
                high = literals[i]
        if low is not None:
            between, before = between.where(F.col("key") > low), passed
        if high is not None:
            between = between.where(F.col("key") < high)
        rounds += 1


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Add ``rank`` (from 1) by a column: a range-partitioned sort, numbered with one offset per partition."""
    placed = stored(rows.orderBy(by).withColumn("_at", F.monotonically_increasing_id()), "winners")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition of the sort is broadcast
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + local + 1).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred
    are drawn, rounded down, by highest score; ties go to the smaller doc_id, null
    ids last, then to fewer features and the smaller weight. Null texts count as
    empty: no features, weight 0. Repeated rows count and compete each for itself.
    An empty table gives no rows; an empty target gives every bucket its share of
    nothing and still draws. Further columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = stored(score_documents(docs, gain, seed), "scores")
    able = scored.where(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score", key_column().alias("key"))
    k = percent * able.count() // 100
    last = kth_key(able, k) if k else None
    columns = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    within = F.col("key") <= _literal(last, able.schema["key"].dataType)
    winners = ranked(able.where(within), "key").select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    tested = scored.withColumn("key", key_column())
    others = tested.where(~((F.col("n_words") >= least_words) & within)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return winners.unionByName(others)

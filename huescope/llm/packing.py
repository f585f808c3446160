"""Best-fit decreasing packing of token sequences, for a corpus of any size.

Pieces that are equally long are interchangeable, so the only thing best-fit
decreasing needs of the corpus is how many pieces have each length: at most
``capacity`` numbers, gathered by one aggregate. The driver plays the packing on
them with whole classes of bins: for each length, longest first, a segment tree
over remaining capacities finds the tightest open bins in logarithmic time, and
as many pieces as fit go there at once. The plan says, for ranks in a length
class, which bins they enter at which offset. It is bounded by the capacity, not
by the corpus: ``plan_packing`` states the bound. Tasks then number the pieces of
a length (split into many groups, so a length with a third of all rows is no hot
group) and read their place from the plan.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty

CAPACITY, SEPARATOR = 4096, 1
#: Texts of these characters only are cut into pre-tokens here, others by the tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: The tokenizer's own pre-token pattern, for lower-cased text of those characters.
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
).findall
#: Entries of a worker's memory of words; it starts afresh when full.
_REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds(dict):
    """Ids of blank-separated chunks, as little-endian unsigned 32-bit bytes.

    A blank always ends a pre-token and leaves no id, so a text's ids are its
    chunks' ids in order; each different chunk is tokenized once per worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.parts = Tokenizer.from_file(path), {}
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        if _PLAIN(chunk) and not any(s in chunk for s in self.special):
            made = b"".join(map(self._part, _PARTS(chunk.lower())))
        else:
            made = _packed(self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            self[chunk] = made
        return made

    def _part(self, part: str) -> bytes:
        made = self.parts.get(part)
        if made is None:
            if len(self.parts) >= _REMEMBERED:
                self.parts.clear()
            text = "".join([self.letters[b] for b in part.encode()])
            made = _packed([t.id for t in self.model.tokenize(text)])
            if len(part) <= 64:
                self.parts[part] = made
        return made

    def ids(self, text: str) -> bytes:
        """The ids of a text without special tokens around it."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory per worker process and vocabulary."""
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and separator.

    Null text counts as empty and gives the separator alone. Only documents
    longer than the capacity are cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = _packed([separator])

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        words = word_ids(vocabulary)
        for doc_id, text in incoming:
            ids = words.ids(text) + end
            for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + capacity)]
                yield doc_id, n, start, len(part) // 4, zlib.crc32(part)

    return arrow_map(docs, rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", 20_000)


class _Tightest:
    """Segment tree over remaining capacities: is any bin open with that much left?"""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def mark(self, remaining: int, is_open: bool) -> None:
        node = self.leaves + remaining
        self.open[node] = int(is_open)
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that has an open bin."""
        node = self.leaves + least
        if not self.open[node]:
            while node % 2 or not self.open[node + 1]:  # up until a right neighbour has one
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on length counts: (length, first_rank, count, first_bin, offset).

    Pieces of ``length`` with ranks first_rank.. go one each into bins first_bin..
    at ``offset``. Each step fills a run of bins, or as
    many of it as a length fills, and a last one takes what is left of the length;
    so the rows are bounded by the capacity, whatever the number of documents.
    """
    tree, runs, plan, bins = _Tightest(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:  # as many new bins as are filled, then one for what is left
                fresh = left // (capacity // length) or 1
                runs[capacity].append((bins, fresh))
                bins, remaining = bins + fresh, capacity
            first, count = runs[remaining].pop()
            # The tightest bin stays the tightest until it is filled: whole bins, or one for the last pieces.
            each = min(remaining // length, left)
            used = min(count, left // each)
            if used < count:
                runs[remaining].append((first + used, count - used))
            tree.mark(remaining, bool(runs[remaining]))
            for _ in range(each):
                plan.append((length, rank, used, first, capacity - remaining))
                rank, left, remaining = rank + used, left - used, remaining - length
            if remaining:
                runs[remaining].append((first, used))
                tree.mark(remaining, True)
    return plan


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR, salts: int = 1024
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each for itself; null ids are kept; ties in length go
    by (doc_id, piece, ids_crc32). Each length is numbered in ``salts`` groups.
    Empty input gives no rows.
    """
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    cut = stored(pieces(texts, vocabulary, capacity, separator), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    salted = cut.withColumn("salt", salt)
    sizes = stored(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("rows")), "length-counts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    counts = sizes.groupBy("length").agg(F.sum("rows").alias("rows")).collect()  # at most `capacity` rows
    plan = np.array(plan_packing({r["length"]: r["rows"] for r in counts}, capacity), dtype=np.int64).reshape(-1, 5)
    ranked = salted.withColumn("place", F.row_number().over(group) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank")
    )
    return _placed(ranked, plan)


def _placed(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """Read each piece's bin and offset from the plan."""
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = ranked.sparkSession.sparkContext.broadcast(plan)
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        starts = rows[:, 0] << np.int64(48) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(starts, length << np.int64(48) | rank, side="right") - 1
            bins = rows[at, 3] + rank - rows[at, 1]
            columns = [batch.column(i) for i in range(5)] + [pa.array(bins), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)

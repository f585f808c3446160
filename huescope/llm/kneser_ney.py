"""Quality by perplexity under an interpolated modified Kneser-Ney model.

One model of character n-grams for each language, counted over all trusted text
but a held-out fifth. Tasks count the n-grams of their own rows and hand on each
different one once; the sums, continuation counts, contexts and discounts are
sharded joins and aggregates keyed by n-gram, so no table is gathered anywhere.

Scoring joins counts to documents in shards as well. Documents are stored in
blocks (one for each writing task); the different n-grams of a block are joined
to the model, and the answers are stored by block. A scoring task reads the
answers of its own block only, whose number is bounded by the block's text, and
adds up the log probabilities of every character of every document.

A document is kept when its steadied perplexity is at most its language's quantile
of the same over held-out trusted documents. Steadied: ``STEADY`` characters of the
language's mean log probability are added, so a few odd characters do not condemn a
short text. A language without held-out text keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty
from huescope.sources.shared import fresh_path

ORDER = 4
#: One trusted document in so many is not counted but sets the threshold.
HELD_OUT = 5
#: Share of held-out trusted documents that a language's threshold keeps.
QUANTILE = 0.999
#: Characters of average text added to each document before it is judged.
STEADY = 100
#: Characters that are turned into n-grams at once.
_SLICE = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(part: str) -> np.ndarray:
    return np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _mixed(columns: np.ndarray) -> np.ndarray:
    """A 64-bit number for each n-gram; ``columns`` has a row for each of its characters."""
    mixed = np.zeros(columns.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            mixed = (mixed ^ column.astype(np.uint64)) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return mixed


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The numbers of all n-grams of consecutive code points."""
    return _mixed(np.lib.stride_tricks.sliding_window_view(codes, order).T)


def _grams_of(texts: list[str], order: int) -> tuple[list[str], list[int]]:
    """The different n-grams of some parts of ``_slices`` and how often each occurs."""
    codes = [_codes(t) for t in texts]
    joined = np.concatenate(codes)
    hashes = _hashes(joined, order)
    inner = np.ones(len(hashes), dtype=bool)
    for at in np.cumsum([len(c) for c in codes])[:-1].tolist():
        inner[at - order + 1 : at] = False  # n-grams over two texts
    places = np.flatnonzero(inner)
    _, first, counts = np.unique(hashes[inner], return_index=True, return_counts=True)
    starts = places[first]
    windows = np.lib.stride_tricks.sliding_window_view(joined, order)[starts]
    flat = np.ascontiguousarray(windows).tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + order] for i in range(0, len(flat), order)], counts.tolist()


def _count_rows(order: int):
    """Folds rows (key, text) to (key, n-gram, count), each n-gram once for each slice of text."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict = {}
        pending: dict = {}
        held = 0

        def fold() -> None:
            for key, texts in pending.items():
                mine = seen.setdefault(key, {})
                for gram, count in zip(*_grams_of(texts, order)):
                    mine[gram] = mine.get(gram, 0) + count
            pending.clear()

        for *key, text in incoming:
            for part in _slices(text, order):
                pending.setdefault(tuple(key), []).append(part)
                held += len(part) + order
                if held >= _SLICE:
                    fold()
                    held = 0
                    if sum(map(len, seen.values())) > 400_000:
                        yield from _drain(seen)
        fold()
        yield from _drain(seen)

    return rows


def _slices(text: str, order: int) -> Iterator[str]:
    """A text in parts that together have its n-grams, each once.

    Line ends stand for what comes before the text; each later part begins with
    the last characters of the part before, so no context is lost at the joins.
    """
    before = order - 1
    for start in range(0, len(text), _SLICE):
        context = text[start - before : start] if start >= before else ("\n" * before + text[:start])[-before:]
        yield (context if before else "") + text[start : start + _SLICE]


def _drain(seen: dict) -> Iterator[tuple]:
    for key, grams in seen.items():
        for gram, count in grams.items():
            yield *key, gram, count
    seen.clear()


def counted(texts: DataFrame, order: int) -> DataFrame:
    """lang, gram, count over rows (lang, text)."""
    folded = arrow_map(texts.select("lang", "text"), _count_rows(order), "lang string, gram string, count long", 20_000)
    return folded.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def trained_counts(blocks: DataFrame, roles: str, order: int) -> DataFrame:
    """``counted`` over the documents of each block that are trusted and not held out."""
    fold = _count_rows(order)

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        return fold((lang, text) for role, _, lang, text in _with_roles(incoming, roles) if role == "trained")

    chosen = blocks.select("block", "doc_id", "lang", "text")
    folded = arrow_map(chosen, rows, "lang string, gram string, count long", 20_000)
    return folded.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _with_roles(incoming: Iterator[tuple], roles: str) -> Iterator[tuple]:
    """Rows (block, doc_id, ...) as (role, doc_id, ...); each block's roles are read once."""
    at, known = None, {}
    for block, doc_id, *rest in incoming:
        if block != at:
            table = read_side(roles, block)
            at, known = block, {} if table is None else dict(zip(table["doc_id"].to_pylist(), table["role"].to_pylist()))
        yield known.get(doc_id, "plain"), doc_id, *rest


def write_sides(rows: DataFrame, name: str) -> str:
    """Write rows by their block, so that a task can read what belongs to its block only."""
    path = fresh_path(rows.sparkSession, name)
    placed = rows.repartition("block").sortWithinPartitions("block")
    placed.write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def read_side(path: str, block: int) -> pa.Table | None:
    """The rows of a block that ``write_sides`` wrote; None if there are none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    place = f"{place}/block={block}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in files])


def _context(gram: Column, size: int) -> Column:
    return F.substring(gram, 1, size - 1)


def _suffix(gram: Column, size: int) -> Column:
    return F.substring(gram, 2, size - 1)


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified discounts from how many n-grams occur one to four times."""
    n = [F.greatest(F.sum(F.when(F.col("count") == k, 1).otherwise(0)), F.lit(1)).alias(f"n{k}") for k in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    held = [F.greatest(F.lit(0.0), F.least(F.lit(float(k)), c)).alias(f"d{k}") for k, c in zip((1, 2, 3), d)]
    return counts.groupBy("lang").agg(*n).select("lang", *held)


def model_tables(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Model of the highest order's counts (lang, gram, count). For each order from 1: (lang, gram, p) and (lang, context, gamma), stored.

    Orders below the highest count in how many contexts an n-gram occurs. The
    unigrams give way to an even distribution over the seen characters and one more.
    """
    by_size = {order: stored(counts, "grams")}
    for size in range(order - 1, 0, -1):
        longer = by_size[size + 1].select("lang", _suffix(F.col("gram"), size + 1).alias("gram"))
        by_size[size] = stored(longer.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("count")), "grams")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for size in range(1, order + 1):
        grams = by_size[size].join(_discounts(by_size[size]), "lang")
        grams = grams.withColumns({
            "context": _context(F.col("gram"), size),
            "discount": F.when(F.col("count") == 1, F.col("d1")).when(F.col("count") == 2, F.col("d2")).otherwise(F.col("d3")),
        })
        contexts = grams.groupBy("lang", "context").agg(
            F.sum("count").alias("total"), (F.sum("discount") / F.sum("count")).alias("gamma"), F.count(F.lit(1)).alias("follow")
        )
        contexts = stored(contexts, "contexts")
        own = grams.join(contexts, ["lang", "context"])
        if size == 1:
            below = 1.0 / (F.col("follow") + 1)
        else:
            lower = tables[-1][0].select("lang", F.col("gram").alias("low"), F.col("p").alias("below"))
            own = own.withColumn("low", _suffix(F.col("gram"), size)).join(lower, ["lang", "low"])
            below = F.col("below")
        chance = (F.col("count") - F.col("discount")) / F.col("total") + F.col("gamma") * below
        tables.append((stored(own.select("lang", "gram", chance.alias("p")), "model"), contexts))
    return tables


def log_chances(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, gram, logp for rows (lang, gram): the model's, backing off where it has no count.

    Languages that the model doesn't know have no rows.
    """
    size = len(tables)
    evens = tables[0][1].select("lang", (F.col("gamma") / (F.col("follow") + 1)).alias("even"))
    found = grams.join(evens, "lang")
    for k in range(size, 0, -1):
        chances, contexts = tables[k - 1]
        found = found.withColumn("tail", F.substring("gram", size - k + 1, k))
        found = found.join(chances.select("lang", F.col("gram").alias("tail"), F.col("p").alias(f"p{k}")), ["lang", "tail"], "left")
        if k > 1:
            found = found.withColumn("context", _context(F.col("tail"), k))
            gammas = contexts.select("lang", "context", F.col("gamma").alias(f"gamma{k}"))
            found = found.join(gammas, ["lang", "context"], "left").drop("context")
        found = found.drop("tail")
    chance = F.coalesce(F.col("p1"), F.col("even"))
    for k in range(2, size + 1):
        chance = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"gamma{k}"), F.lit(1.0)) * chance)
    return found.select("lang", "gram", F.log(chance).cast("float").alias("logp"))


def _scores(blocks: DataFrame, roles: str, answers: str, order: int) -> DataFrame:
    """doc_id, lang, role, chars, loss (negative log probability) of the documents of each block."""
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        at, known = None, {}
        for role, doc_id, lang, text, block in _with_roles(incoming, roles):
            if block != at:
                at, known = block, _answers_of(read_side(answers, block), order)
            if lang not in known or not text:
                yield doc_id, lang, role, len(text), None
                continue
            keys, values = known[lang]
            total = 0.0
            for part in _slices(text, order):
                hashes = _hashes(_codes(part), order)
                total += float(values[np.searchsorted(keys, hashes)].sum(dtype=np.float64))
            yield doc_id, lang, role, len(text), round(-total, 6)

    chosen = blocks.select("block", "doc_id", "lang", "text", F.col("block").alias("own"))
    return arrow_map(chosen, rows, f"doc_id {kind}, lang string, role string, chars long, loss double", 5000)


def _answers_of(table: pa.Table | None, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """A block's n-grams, as sorted hashes, and their log probabilities by language."""
    import pyarrow.compute as pc

    found = {}
    for lang in [] if table is None else table.column("lang").unique().to_pylist():
        part = table.filter(pc.equal(table.column("lang"), lang))
        flat = "".join(part.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
        hashes = _mixed(np.frombuffer(flat, "<u4").reshape(-1, order).T)
        by = np.argsort(hashes)
        found[lang] = (hashes[by], part.column("logp").to_numpy()[by])
    return found


def score_documents(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, steadied, threshold, kept.

    ``trusted`` has the doc_ids of trusted documents. Null language is a language of
    its own (the empty one); null or empty text, or a language without trusted text, has no
    perplexity and is kept. Repeated rows are scored each; empty input gives no
    rows; further columns are ignored.
    """
    ids = pick(trusted, "doc_id").where("doc_id is not null").distinct()
    given = pick(docs, "doc_id", "text", "lang").select(
        "doc_id", text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    )
    blocks = stored(given.withColumn("block", F.spark_partition_id()), "blocks")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    role = F.when(held, "held").otherwise("trained").alias("role")
    roles = write_sides(blocks.select("block", "doc_id").join(ids, "doc_id").select("block", "doc_id", role), "roles")
    tables = model_tables(trained_counts(blocks, roles, order), order)
    folded = arrow_map(
        blocks.where("text <> ''").select("block", "lang", "text"),
        _count_rows(order), "block int, lang string, gram string, count long", 20_000,
    )
    asked = stored(folded.select("block", "lang", "gram").distinct(), "block-grams")
    answers = stored(log_chances(asked.select("lang", "gram").distinct(), tables), "answers")
    path = write_sides(asked.join(answers, ["lang", "gram"]), "block-answers")
    scored = stored(_scores(blocks, roles, path, order), "perplexities")
    held = scored.where("role = 'held' and loss is not null")
    means = held.groupBy("lang").agg((F.sum("loss") / F.sum("chars")).alias("mean"))
    steadied = scored.join(means, "lang", "left").withColumn(
        "steadied", F.exp((F.col("loss") + STEADY * F.col("mean")) / (F.col("chars") + STEADY))
    )
    limits = steadied.where("role = 'held' and loss is not null").groupBy("lang").agg(
        F.percentile_approx("steadied", quantile, 10_000).alias("threshold")
    )
    judged = steadied.join(limits, "lang", "left")
    kept = F.coalesce(F.col("steadied") <= F.col("threshold"), F.lit(True))
    perplexity = F.round(F.exp(F.col("loss") / F.col("chars")), 6)
    return judged.select(
        "doc_id", "lang", perplexity.alias("perplexity"), F.round("steadied", 6).alias("steadied"), "threshold", kept.alias("kept")
    )

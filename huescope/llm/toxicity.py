"""Toxicity severity by cumulative-link ordinal regression.

Labels say toxic or not; severity grades come from them: 0 for documents labelled
clean, 1 to 3 for toxic ones by how many words they hold that mark toxic
documents (thirds of the sampled toxic documents). Those marking words, and the
other words the model looks at, are found by counting, over a sample of labelled
documents, in how many toxic and clean ones each word occurs. The sample has at
most ``SAMPLE_ROWS`` documents of each verdict, so it is chosen by id, sent to the
scan of the documents, and no text is shuffled for it.

The model is the proportional-odds one: P(grade > k) = sigmoid(w . x - cut[k]),
one weight vector for all ordered cuts. x is sparse: log counts of the chosen
words, weaker in texts of more than ``FREE_WORDS`` words, which hold a few by chance. The expected severity is the sum of the three probabilities; a document
is toxic when grade 0 is less likely than the rest together. One more feature counts all marking words together,
so that a rare one weighs like its kind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty

#: Bound on the labelled documents of each verdict that the model is fitted on.
SAMPLE_ROWS = 10_000
#: Words the model looks at, the least toxic documents that must hold one, and the
#: least likelihood-ratio statistic of its difference between the verdicts.
MODEL_WORDS, LEAST_TOXIC, LEAST_G2 = 500, 5, 20.0
#: A word marks toxic documents when this many times as common there as in clean ones.
MARKING_ODDS = 8.0
GRADES = 3
FREE_WORDS = 200
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


@dataclass
class SeverityModel:
    """Chosen words, their weights and the ordered cuts."""

    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    marking: frozenset[str]

    def exceed(self, text: str) -> list[float]:
        """P(grade > k) for k = 0 .. GRADES - 1."""
        score = sum(self.weights[i] * x for i, x in features(text, self.words, self.marking))
        return [1 / (1 + math.exp(min(700.0, max(-700.0, c - score)))) for c in self.cuts]


def features(text: str, words: dict[str, int], marking: frozenset[str]) -> list[tuple[int, float]]:
    """(index, log count) of the model's words in a text; behind them, of all marking words together."""
    counts: dict[int, int] = {}
    hits, found = 0, words_of(text)
    for word in found:
        i = words.get(word)
        if i is not None:
            counts[i] = counts.get(i, 0) + 1
            hits += word in marking
    if hits:
        counts[len(words)] = hits
    weaker = 1 + math.log(max(1.0, len(found) / FREE_WORDS))
    return [(i, math.log1p(n) / weaker) for i, n in sorted(counts.items())]


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, toxic_docs, clean_docs over labelled documents (doc_id, text, toxic)."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict[str, list[int]] = {}
        for text, toxic in incoming:
            for word in set(words_of(text)):
                seen.setdefault(word[:64], [0, 0])[int(toxic)] += 1
            if len(seen) > 300_000:  # hand on what this task has folded so far
                yield from ((w, t, c) for w, (c, t) in seen.items())
                seen = {}
        yield from ((w, t, c) for w, (c, t) in seen.items())

    folded = arrow_map(labelled.select("text", "toxic"), rows, "word string, toxic_docs long, clean_docs long", 20_000)
    return folded.groupBy("word").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def _likelihood_ratio(toxic: int, clean: int) -> Column:
    """G squared of a word's document counts against equal shares in both classes."""
    share = (F.col("toxic_docs") + F.col("clean_docs")) / F.lit(float(toxic + clean))

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    cells = [(F.col("toxic_docs"), float(toxic)), (F.col("clean_docs"), float(clean))]
    terms = [term(n, size * share) + term(size - n, size * (1 - share)) for n, size in cells]
    return 2 * (terms[0] + terms[1])


def choose_words(labelled: DataFrame) -> tuple[dict[str, int], frozenset[str]]:
    """The words with the clearest difference between the classes, and those that mark toxic ones."""
    totals = labelled.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    toxic, clean = totals["toxic"] or 0, (totals["rows"] or 0) - (totals["toxic"] or 0)
    if not toxic or not clean:
        return {}, frozenset()
    odds = F.log((F.col("toxic_docs") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean_docs") + 0.5) / (clean + 1.0))
    counts = word_counts(labelled).where(F.col("toxic_docs") >= LEAST_TOXIC)
    scored = counts.withColumns({"odds": odds, "g2": _likelihood_ratio(toxic, clean)})
    best = scored.where(F.col("g2") > LEAST_G2).orderBy(F.col("g2").desc(), "word").limit(MODEL_WORDS)
    best = best.select("word", "odds").collect()
    marking = frozenset(r["word"] for r in best if r["odds"] > math.log(MARKING_ODDS))
    return {r["word"]: i for i, r in enumerate(best)}, marking


def fit(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    """Fit on a bounded sample of labelled documents; without both verdicts nothing is toxic.

    At most ``SAMPLE_ROWS`` documents of each verdict are taken, those with the
    smallest hash of their id; equal texts count once. Labels with nulls are left
    out, of several verdicts on one document toxic wins.
    """
    verdicts = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    verdicts = stored(verdicts.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "verdicts")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [verdicts.where(F.col("toxic") == v).orderBy(*order).limit(SAMPLE_ROWS) for v in (0, 1)]
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    # at most 2 x SAMPLE_ROWS ids are broadcast
    sample = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    labelled = stored(sample.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled-sample")
    words, marking = choose_words(labelled)
    if not words:
        return SeverityModel({}, np.zeros(0), np.full(GRADES, 50.0), marking)

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, toxic in incoming:
            found = features(text, words, marking)
            hits = sum(1 for w in words_of(text) if w in marking) if toxic else 0
            yield doc_id, toxic, hits, [i for i, _ in found], [x for _, x in found]

    kind = labelled.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, toxic int, hits long, at array<int>, x array<double>"
    sparse = stored(arrow_map(labelled.select("doc_id", "text", "toxic"), rows, schema), "severity-rows")
    sample = sorted(sparse.collect(), key=lambda r: (r["doc_id"], r["toxic"], r["hits"], r["at"]))
    hits = sorted(r["hits"] for r in sample if r["toxic"])
    thirds = [hits[len(hits) * k // GRADES] for k in range(1, GRADES)]
    grade = np.array([r["toxic"] + sum(r["toxic"] and r["hits"] > t for t in thirds) for r in sample])
    sizes = np.array([len(r["at"]) for r in sample])
    at = np.array([i for r in sample for i in r["at"]], dtype=np.int64)
    x = np.array([v for r in sample for v in r["x"]])
    weights, cuts = fit_cumulative(np.repeat(np.arange(len(sample)), sizes), at, x, grade, len(words) + 1)
    return SeverityModel(words, weights, cuts, marking)


def fit_cumulative(
    row: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, steps: int = 600, ridge: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by accelerated gradient (Adam) on the mean log loss.

    The grades' likelihood is the difference of neighbouring sigmoids. Cuts are the
    first one plus positive gaps, so they stay ordered.
    """
    count = len(grade)
    params = np.concatenate([np.zeros(width), [0.0], np.zeros(GRADES - 1)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    bound = np.float64(1e-9)
    for step in range(1, steps + 1):
        weights, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, weights[at] * x, minlength=count)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = edges[grade + 1] - score, edges[grade] - score
        with np.errstate(over="ignore"):
            high, low = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        chance = np.maximum(high - low, bound)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        slope = (d_high - d_low) / count  # of the loss by the score
        d_edges = np.bincount(grade + 1, -d_high, minlength=GRADES + 2) + np.bincount(grade, d_low, minlength=GRADES + 2)
        d_cuts = d_edges[1 : GRADES + 1] / count
        d_gaps = np.array([d_cuts[k:].sum() for k in range(1, GRADES)]) * gaps
        gradient = np.concatenate([np.bincount(at, slope[row] * x, minlength=width) + ridge * weights, [d_cuts.sum()], d_gaps])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        params = params - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
    first, gaps = params[width], np.exp(params[width + 1 :])
    return params[:width], first + np.concatenate([[0.0], np.cumsum(gaps)])


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, grade, expected_severity, p_toxic, kept for every document's whole text.

    Null text counts as empty. Repeated rows are scored each; empty input gives no
    rows; further columns are ignored.
    """
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in incoming:
            exceed = model.exceed(text)
            steps = [1.0, *exceed, 0.0]
            chances = [a - b for a, b in zip(steps, steps[1:])]
            grade = max(range(GRADES + 1), key=chances.__getitem__)
            yield doc_id, grade, round(sum(exceed), 6), round(exceed[0], 6), exceed[0] < 0.5

    return arrow_map(texts, rows, f"doc_id {kind}, grade int, expected_severity double, p_toxic double, kept boolean", 20_000)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model fitted on ``labels`` doesn't reject, all their columns."""
    model = fit(docs, labels)
    places = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*places)
    text = places[docs.columns.index("text")]

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([model.exceed(str(t or ""))[0] < 0.5 for t in texts], pa.bool_()))

    return numbered.mapInArrow(keep, numbered.schema).toDF(*docs.columns)

"""Quality rules: fixed base rules and robust multivariate outliers.

Each document gets a vector of transformed statistics. For every language and
source the minimum-covariance-determinant estimate is found by concentration
steps that run as aggregates over all documents, from medians and interquartile
ranges on: distances under the current estimate, the ``SHARE`` of rows with the smallest distances, their mean and
covariance, again, until the determinants no longer fall. Which distances are
smallest is read from counts per narrow band of the distance, and mean and covariance
from the bands' sums: a step reads every row once, and a group with a
third of all rows folds on the map side like any other. A document whose
Mahalanobis distance under the final estimate is beyond the chi-squared quantile
is rejected.

Groups below ``LEAST_GROUP`` rows are pooled by language, then altogether. Each
statistic has a least standard deviation (``FLOORS``), so one that is constant in
the core of a group (no symbols at all, say) doesn't reject all that differ.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty

#: Share of a group's rows that the estimate is made from.
SHARE = 0.75
#: Least rows of a (language, source) group with an estimate of its own.
LEAST_GROUP = 100
#: Chi-squared quantiles with six degrees of freedom at 0.75 and at 1 - 1e-5.
CHI_SHARE, CHI_CUT = 7.8408, 33.107
#: Least standard deviations: log words, log word length, symbols, repeated lines, repeated words, capitals.
FLOORS = (0.5, 0.15, 0.5, 0.15, 0.15, 0.15)
#: Steps after which a warning takes the place of convergence, and the fall of a log determinant that counts as none.
MOST_STEPS, STILL = 30, 0.01
BANDS = 16
DIMENSIONS = len(FLOORS)
_BLANKS, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


def statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (
        len(words),
        chars,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(str.isupper, text)) if not text.islower() else 0,
    )


def repeated_words(words: list) -> int:
    """Words that lie in a 5-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, count = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            count += i + 5 - max(covered, i)
            covered = i + 5
    return count


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, the vector v0 .. v5 and base_failed."""
    chosen = pick(docs, "doc_id", "text", "lang", "source").select(
        "doc_id", text_or_empty().alias("text"), F.col("lang").cast("string"), F.col("source").cast("string")
    )
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, lang, source in incoming:
            yield doc_id, lang, source, *statistics(text)

    columns = "".join(f", {n} long" for n in (*STATISTICS, "n_capitals"))
    counted = arrow_map(chosen, rows, f"doc_id {kind}, lang string, source string{columns}", 20_000)
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    vector = [
        F.log1p("n_words"),
        F.log(chars / words),
        F.asinh(100 * F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_capitals") / chars),
    ]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({f"v{i}": c for i, c in enumerate(vector)} | {"base_failed": failed})


def _grouped(counted: DataFrame, least_group: int) -> DataFrame:
    """Adds the pooled language and source whose estimate a row uses: lang_of, source_of."""
    sizes = counted.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    alone = F.col("rows") >= least_group
    small = Window.partitionBy("lang", alone)
    pooled = sizes.withColumn("pool", F.sum("rows").over(small))
    by_lang = F.col("pool") >= least_group
    named = pooled.select(
        F.col("lang").alias("lang_"),
        F.col("source").alias("source_"),
        F.when(alone | by_lang, F.concat(F.lit("="), F.coalesce("lang", F.lit("")))).otherwise("*").alias("lang_of"),
        F.when(alone, F.concat(F.lit("="), F.coalesce("source", F.lit("")))).otherwise("*").alias("source_of"),
    )
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return counted.join(named, same, "left").drop("lang_", "source_")


_V = [f"v{i}" for i in range(DIMENSIONS)]
_UPPER = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
_GROUP = ["lang_of", "source_of"]


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with each variance raised to its floor's square at least, correlations kept.

    A constant statistic has no correlations; those of one shrink by a millionth,
    so that statistics in lockstep leave the matrix invertible.
    """
    deviation = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(deviation > 1e-9, np.maximum(deviation, FLOORS) / np.maximum(deviation, 1e-9), 0.0)
    raised = cov * np.outer(scale, scale) * (1 - 1e-6)
    np.fill_diagonal(raised, np.maximum(deviation, FLOORS) ** 2)
    return raised


def _moments(bands: DataFrame) -> DataFrame:
    """Mean, inverse covariance (with the floors) and log determinant of each group, from the sums of bands."""
    names = [*[f"m_{v}" for v in _V], *[f"p_{i}_{j}" for i, j in _UPPER]]
    averaged = bands.groupBy(*_GROUP).agg(*[(F.sum(n) / F.sum("rows")).alias(n) for n in names])
    schema = "lang_of string, source_of string, centre array<double>, inverse array<double>, log_det double"

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mean = np.array([row[f"m_{v}"] for v in _V])
                cov = np.zeros((DIMENSIONS, DIMENSIONS))
                for i, j in _UPPER:
                    cov[i, j] = cov[j, i] = row[f"p_{i}_{j}"] - mean[i] * mean[j]
                cov = floored(cov)
                inverse = np.linalg.inv(cov).round(9)
                out.append((row["lang_of"], row["source_of"], mean.round(9).tolist(), inverse.ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            if out:
                kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["lang_of", "source_of", "centre", "inverse", "log_det"]
                )

    return stored(averaged.mapInArrow(invert, schema), "mcd")


def _start(rows: DataFrame) -> DataFrame:
    """A first estimate that up to a quarter of outliers cannot move: medians and interquartile ranges."""
    quartiles = rows.groupBy(*_GROUP).agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in _V])
    zero = F.lit(0.0)
    inverse = [
        1.0 / F.pow(F.greatest((F.col(v)[2] - F.col(v)[0]) / 1.349, F.lit(FLOORS[i])), F.lit(2)) if i == j else zero
        for i, v in enumerate(_V)
        for j in range(DIMENSIONS)
    ]
    centre = F.array(*[F.col(v)[1] for v in _V])
    return stored(quartiles.select(*_GROUP, centre.alias("centre"), F.array(*inverse).alias("inverse")), "mcd-start")


def _distance() -> Column:
    """Squared Mahalanobis distance of v under centre and inverse."""
    gaps = [F.col(v) - F.col("centre")[i] for i, v in enumerate(_V)]
    terms = [
        (1 if i == j else 2) * F.col("inverse")[i * DIMENSIONS + j] * gaps[i] * gaps[j] for i, j in _UPPER
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _banded(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with their distance and its band (BANDS bands to a doubling)."""
    near = rows.join(estimate, _GROUP).withColumn("distance", _distance())
    return near.withColumn("band", F.floor(BANDS * F.log2(F.col("distance") + 1e-6)).cast("int"))


def _bands(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Of each group and band the number of rows, and the sums of their values and products."""
    sums = [F.sum(v).alias(f"m_{v}") for v in _V]
    products = [F.sum(F.col(_V[i]) * F.col(_V[j])).alias(f"p_{i}_{j}") for i, j in _UPPER]
    return _banded(rows, estimate).groupBy(*_GROUP, "band").agg(F.count(F.lit(1)).alias("rows"), *sums, *products)


def _cuts(bands: DataFrame) -> DataFrame:
    """The band of each group that holds the row at SHARE."""
    upto = Window.partitionBy(*_GROUP).orderBy("band")
    total = Window.partitionBy(*_GROUP)
    seen = bands.withColumns({"upto": F.sum("rows").over(upto), "total": F.sum("rows").over(total)})
    return seen.where(F.col("upto") >= SHARE * F.col("total")).groupBy(*_GROUP).agg(F.min("band").alias("cut"))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """lang_of, source_of, centre, inverse, scale: the estimate of each group of ``rows``.

    Steps go on until no group's determinant falls below its lowest so far, however
    many groups there are.
    """
    estimate, lowest = _start(rows), None
    for _ in range(MOST_STEPS):
        bands = stored(_bands(rows, estimate), "mcd-bands")
        estimate = _moments(bands.join(_cuts(bands), _GROUP).where("band <= cut"))
        reached = estimate.select(*_GROUP, "log_det")
        if lowest is None:
            lowest = reached
            continue
        both = lowest.withColumnRenamed("log_det", "before").join(reached, _GROUP)
        lowest = stored(both.select(*_GROUP, "before", F.least("before", "log_det").alias("log_det")), "mcd-lowest")
        if (lowest.agg(F.max(F.col("before") - F.col("log_det"))).first()[0] or 0.0) < STILL:
            break
        lowest = lowest.drop("before")
    else:
        warnings.warn(f"some covariance still falls after {MOST_STEPS} steps", stacklevel=2)
    cuts = _cuts(_bands(rows, estimate))
    edge = F.pow(F.lit(2.0), (F.col("cut") + 1) / BANDS)
    return estimate.join(cuts, _GROUP).withColumn("scale", F.greatest(F.lit(1.0), edge / CHI_SHARE))


def quality_rules(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null text has no words and fails; a null language or source is a value of its
    own. Repeated rows count each. Empty input gives no rows; further columns are
    ignored. Documents that fail the base rules are rejected whatever their distance.
    """
    rows = stored(_grouped(document_statistics(docs), least_group), "statistics")
    final = stored(robust_estimates(rows), "mcd-final")
    judged = rows.join(final, _GROUP, "left").withColumn("distance", _distance() / F.col("scale"))
    outlying = F.coalesce(F.col("distance") > CHI_CUT, F.lit(False))
    return judged.select(
        "doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & ~outlying).alias("kept"), "distance"
    )

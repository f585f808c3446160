"""Declarations to contrast pairings and page statistics, on rows.

One unreadable colour fails its whole page, so the declarations of a page meet in
one exchange by page, and everything after that shares it: the error test, the
first of equal pairs, the statistics and the worst list are windows and
aggregates over the page or over keys that start with it. Pages are tokenised
once. The exchange brings a page's rows to one task, where they came from: all of
them were made from one page row by one task, and sorting there spills.

Rows that are pairs already pre-aggregate before they are shuffled: duplicates are
cut to one per task by the window's group limit, page statistics keep counters
and a bounded histogram, and a worst list keeps five rows per task. There a key
that owns a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huescope.functions.colours import (
    BLACK,
    LARGE_TEXT_MINIMUM,
    NORMAL_TEXT_MINIMUM,
    UNREADABLE,
    WHITE,
    ratio_of_luminances,
    relative_luminance,
    unreadable_message,
    with_colour_code,
)
from huescope.functions.numeric import exact_mean, percent, round_half_even, upper_median

# Labels of the colour that a declaration leaves open.
ASSUMED_BACKGROUND = "#ffffff (assumed)"
ASSUMED_FOREGROUND = "#000000 (assumed)"

WORST_PER_PAGE = 5


def with_codes(declarations: DataFrame) -> DataFrame:
    """Parse both colours of a declaration into ``fg`` and ``bg`` codes."""
    return with_colour_code(with_colour_code(declarations, "color", "fg"), "background", "bg")


def is_unreadable() -> Column:
    return (
        F.coalesce(F.col("unreadable"), F.lit(False))
        | F.coalesce(F.col("fg") == UNREADABLE, F.lit(False))
        | F.coalesce(F.col("bg") == UNREADABLE, F.lit(False))
    )


def flag_pages(coded: DataFrame, key: str = "domain") -> DataFrame:
    """Add ``page_failed``: whether any declaration of the page is unreadable. One exchange by page."""
    return coded.withColumn("page_failed", F.max(is_unreadable()).over(Window.partitionBy(key)))


def _is_pair() -> Column:
    return F.col("fg").isNotNull() | F.col("bg").isNotNull()


def build_pairings(coded: DataFrame, key: str = "domain") -> DataFrame:
    """Complete each declaration to a pair; the missing side is assumed.

    A side counts as missing when its value is no colour, e.g. ``transparent``.
    A page with an unreadable colour has no pairs at all.
    """
    kept = [c for c in coded.columns if c not in ("color", "background", "fg", "bg", "unreadable", "failing")]
    readable = flag_pages(coded, key).where(~F.col("page_failed") & _is_pair())
    return readable.select(
        *kept,
        F.when(F.col("fg").isNotNull(), F.col("color"))
        .otherwise(F.lit(ASSUMED_FOREGROUND))
        .alias("foreground"),
        F.when(F.col("bg").isNotNull(), F.col("background"))
        .otherwise(F.lit(ASSUMED_BACKGROUND))
        .alias("background"),
        F.coalesce("fg", F.lit(BLACK)).alias("fg"),
        F.coalesce("bg", F.lit(WHITE)).alias("bg"),
        (F.col("fg").isNotNull() & F.col("bg").isNotNull()).alias("explicit"),
    )


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Add the rounded ratio and both verdicts, which use the exact ratio."""
    exact = pairs.withColumns(
        {"one": relative_luminance(F.col("fg")), "other": relative_luminance(F.col("bg"))}
    ).withColumn("exact", ratio_of_luminances(F.col("one"), F.col("other")))
    return exact.select(
        *pairs.columns,
        round_half_even(F.col("exact"), 2).alias("ratio"),
        (F.col("exact") >= NORMAL_TEXT_MINIMUM).alias("pass_normal"),
        (F.col("exact") >= LARGE_TEXT_MINIMUM).alias("pass_large"),
    )


def dedup_pairings(pairs: DataFrame, key: str = "domain") -> DataFrame:
    """One row per page and colour pair: the first in document order."""
    first = Window.partitionBy(key, "fg", "bg").orderBy("seq")
    return pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def _page_counts(is_pair: Column) -> list[Column]:
    """Aggregates over a page's deduplicated pairings; rows that are no pair have null ratios."""
    return [
        F.count_if(is_pair).alias("total_pairings"),
        F.count_if("pass_normal").alias("pass_normal"),
        F.count_if("pass_large").alias("pass_large"),
        F.min("ratio").alias("worst_ratio"),
        F.max("ratio").alias("best_ratio"),
        upper_median("ratio").alias("median_ratio"),
        exact_mean(F.col("ratio"), 2).alias("mean_ratio"),
    ]


def _page_statistics(counted: DataFrame, key: str, *more: str) -> DataFrame:
    total = F.col("total_pairings")
    return counted.select(
        key,
        *more,
        total,
        "pass_normal",
        (total - F.col("pass_normal")).alias("fail_normal"),
        "pass_large",
        (total - F.col("pass_large")).alias("fail_large"),
        percent(F.col("pass_normal"), total).alias("pass_rate_normal"),
        percent(F.col("pass_large"), total).alias("pass_rate_large"),
        "worst_ratio",
        "best_ratio",
        "median_ratio",
        round_half_even(F.col("mean_ratio"), 2).alias("mean_ratio"),
    )


def page_contrast_summary(pairings: DataFrame, key: str = "domain") -> DataFrame:
    """Counts, pass rates and ratio statistics per page over deduplicated pairings."""
    return _page_statistics(pairings.groupBy(key).agg(*_page_counts(F.lit(True))), key)


def page_summary_empty(coded: DataFrame, key: str = "domain") -> DataFrame:
    """Statistics and ``status`` of every page: zero counts, NULL rates and ratios without pairings.

    ``coded`` has a row for every page, as ``union_declarations`` gives with
    ``every_page``; what is no pair folds to one row of its page.
    """
    flagged = flag_pages(coded, key)
    is_pair = ~F.col("page_failed") & _is_pair()
    sides = flagged.select(
        key,
        "page_failed",
        "seq",
        F.when(is_pair, F.coalesce("fg", F.lit(BLACK))).alias("fg"),
        F.when(is_pair, F.coalesce("bg", F.lit(WHITE))).alias("bg"),
    )
    scored = classify_pairs(dedup_pairings(sides, key))
    counted = scored.groupBy(key).agg(*_page_counts(F.col("fg").isNotNull()), F.max("page_failed").alias("page_failed"))
    named = counted.withColumn("status", F.when(F.col("page_failed"), "error").otherwise("analysed"))
    return _page_statistics(named, key, "status")


def filter_failing_pairings(pairings: DataFrame) -> DataFrame:
    return pairings.where(~F.col("pass_normal"))


def worst_pairings_topk(pairings: DataFrame, key: str = "domain", k: int = WORST_PER_PAGE) -> DataFrame:
    """The k failing pairings of lowest ratio per page, with their ``place``."""
    by_ratio = Window.partitionBy(key).orderBy("ratio", "seq")
    ranked = filter_failing_pairings(pairings).withColumn("place", F.row_number().over(by_ratio))
    return ranked.where(F.col("place") <= k)


def _first_failure() -> Column:
    """(order, text) of a declaration's failing value, NULL if it has none.

    Shorthand values are looked at while styles are read, so any of them comes
    before the colours of pairs; those go by declaration, text colour first.
    """
    seq = F.col("seq")
    return (
        F.when(F.coalesce("unreadable", F.lit(False)), F.struct(F.lit(0).alias("stage"), seq, F.col("failing").alias("text")))
        .when(F.col("fg") == UNREADABLE, F.struct(F.lit(1).alias("stage"), seq, F.col("color").alias("text")))
        .when(F.col("bg") == UNREADABLE, F.struct(F.lit(1).alias("stage"), seq, F.col("background").alias("text")))
    )


def page_status(coded: DataFrame, key: str = "domain") -> DataFrame:
    """status and error of every page: 'error' with an unreadable colour anywhere, else 'analysed'.

    ``error`` tells of the first such value of the page. ``coded`` has a row for
    every page, as for ``page_summary_empty``.
    """
    first = coded.groupBy(key).agg(F.min(_first_failure()).alias("first"))
    text = F.col("first.text")
    return first.select(
        key,
        F.when(F.col("first").isNotNull(), "error").otherwise("analysed").alias("status"),
        F.when(F.col("first").isNotNull(), unreadable_message(text)).alias("error"),
    )

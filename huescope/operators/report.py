"""Page results to corpus statistics, category roll-up, top lists and report.

Aggregates are partial on every task and meet in one small row; medians keep a
histogram of rates with one decimal, at most 1,001 entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huescope.functions.categories import categorise_domain
from huescope.functions.numeric import exact_mean, percent, round_half_even, upper_median
from huescope.sources.shared import materialised

# List lengths, bucket names with their lower bounds, message.
WORST_OFFENDERS = 20
COMPLIANT_SITES = 30
BUCKETS = (
    ("0-25%", 0.0),
    ("25-50%", 25.0),
    ("50-75%", 50.0),
    ("75-90%", 75.0),
    ("90-99%", 90.0),
    ("100%", 100.0),
)
NO_COLOUR_MESSAGE = "No domains with color data found"


def filter_analysed(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "analysed")


def has_colours() -> Column:
    return (F.col("status") == "analysed") & (F.coalesce("total_pairings", F.lit(0)) > 0)


def filter_with_colours(results: DataFrame) -> DataFrame:
    return results.where(has_colours())


def analysis_counts(results: DataFrame) -> DataFrame:
    """(analysed, with_colours) as one row."""
    return results.agg(
        F.count_if(F.col("status") == "analysed").alias("analysed"),
        F.count_if(has_colours()).alias("with_colours"),
    )


def _corpus_columns() -> list[Column]:
    analysed = F.count_if(F.coalesce(F.col("status") == "analysed", F.lit(False)))
    coloured = F.count_if(has_colours())
    return [
        F.count(F.lit(1)).alias("total_domains_in_list"),
        analysed.alias("domains_analysed"),
        coloured.alias("domains_with_color_data"),
        (analysed - coloured).alias("domains_no_color_data"),
        (F.count(F.lit(1)) - analysed).alias("domains_failed"),
    ]


def corpus_counts(results: DataFrame) -> DataFrame:
    return results.agg(*_corpus_columns())


def _total_columns() -> list[Column]:
    return [
        F.sum("total_pairings").alias("total_unique_pairings"),
        F.sum("fail_normal").alias("total_failing_normal"),
        F.sum("fail_large").alias("total_failing_large"),
    ]


def pairing_totals(results: DataFrame) -> DataFrame:
    return filter_with_colours(results).agg(*_total_columns())


def _rate_columns() -> list[Column]:
    normal, large = F.col("pass_rate_normal"), F.col("pass_rate_large")
    return [
        round_half_even(exact_mean(normal, 1), 1).alias("mean_pass_rate_normal"),
        upper_median("pass_rate_normal").alias("median_pass_rate_normal"),
        F.min(normal).alias("min_pass_rate_normal"),
        F.max(normal).alias("max_pass_rate_normal"),
        round_half_even(exact_mean(large, 1), 1).alias("mean_pass_rate_large"),
        upper_median("pass_rate_large").alias("median_pass_rate_large"),
    ]


def rate_stats(results: DataFrame) -> DataFrame:
    return filter_with_colours(results).agg(*_rate_columns())


def _share_columns() -> list[Column]:
    rate = F.col("pass_rate_normal")

    def share(condition: Column, whole: Column) -> Column:
        return percent(F.count_if(condition), whole)

    known = F.count(rate)
    return [
        share(rate == 100, F.count(F.lit(1))).alias("pct_fully_compliant_normal"),
        share(rate >= 90, known).alias("pct_above_90_normal"),
        share(rate >= 75, known).alias("pct_above_75_normal"),
        share(rate < 50, known).alias("pct_below_50_normal"),
    ]


def threshold_shares(results: DataFrame) -> DataFrame:
    return filter_with_colours(results).agg(*_share_columns())


def _bucket_counts() -> list[tuple[str, Column]]:
    rate = F.col("pass_rate_normal")
    uppers = [low for _, low in BUCKETS[1:]] + [None]
    counts = []
    for position, ((name, low), high) in enumerate(zip(BUCKETS, uppers)):
        inside = F.lit(True) if position == 0 else rate >= low
        inside = inside & rate.isNotNull() if high is None else inside & (rate < high)
        counts.append((name, F.count_if(inside)))
    return counts


def pass_rate_histogram(results: DataFrame) -> DataFrame:
    """(position, bucket, sites): all six buckets, in order, also empty ones."""
    counts = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("bucket"), count.alias("sites"))
        for i, (name, count) in enumerate(_bucket_counts())
    ]
    return filter_with_colours(results).agg(F.array(*counts).alias("b")).select(F.inline("b"))


def category_rollup(results: DataFrame) -> DataFrame:
    """Sites, rates and compliance per category; at most one row per rule."""
    rate = F.col("pass_rate_normal")
    return (
        filter_with_colours(results)
        .select(categorise_domain(F.col("domain")).alias("category"), "pass_rate_normal")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("count"),
            round_half_even(exact_mean(rate, 1), 1).alias("avg_pass_rate"),
            upper_median("pass_rate_normal").alias("median_pass_rate"),
            F.count_if(rate == 100).alias("fully_compliant"),
            F.count_if(rate < 50).alias("below_50_pct"),
        )
    )


def sort_categories(rollup: DataFrame, by_rate: bool = False) -> DataFrame:
    """By name, or by descending average rate and then name."""
    if by_rate:
        return rollup.orderBy(F.coalesce("avg_pass_rate", F.lit(0.0)).desc(), "category")
    return rollup.orderBy("category")


def worst_offenders(results: DataFrame, k: int = WORST_OFFENDERS) -> DataFrame:
    """The k sites of lowest pass rate with their first worst pairing; ties by domain."""
    columns = ["domain", "pass_rate_normal", "total_pairings", "fail_normal", "worst_ratio"]
    if "worst_pairings" in results.columns:
        first = F.get("worst_pairings", F.lit(0))
        example = F.when(
            first.isNotNull(),
            F.struct(*[first.getField(f).alias(f) for f in ("foreground", "background", "ratio")]),
        )
        columns.append(example.alias("example_failure"))
    return filter_with_colours(results).select(*columns).orderBy("pass_rate_normal", "domain").limit(k)


def fully_compliant_sites(results: DataFrame, k: int = COMPLIANT_SITES) -> DataFrame:
    """The k compliant sites with most pairings; ties by domain."""
    return (
        filter_with_colours(results)
        .where(F.col("pass_rate_normal") == 100)
        .select("domain", "total_pairings", "mean_ratio")
        .orderBy(F.col("total_pairings").desc(), "domain")
        .limit(k)
    )


def min_worst_ratio(results: DataFrame) -> DataFrame:
    return filter_with_colours(results).agg(F.min("worst_ratio").alias("min_worst_ratio_across_sites"))


def _corpus_row(results: DataFrame, crawl: str) -> DataFrame:
    """Every scalar of the summary in one pass.

    Page statistics are NULL or zero on pages without colours, so nulling the
    rates there lets one aggregate serve both populations.
    """
    statistics = [c for c in results.columns if c.startswith(("pass_rate", "worst_ratio"))]
    masked = results.withColumns({c: F.when(has_colours(), F.col(c)) for c in statistics})
    site = F.count_if(has_colours())
    compliant = F.count_if(F.col("pass_rate_normal") == 100)
    shares = [percent(compliant, site).alias("pct_fully_compliant_normal"), *_share_columns()[1:]]
    sums = [
        F.sum(F.when(has_colours(), F.col(c))).alias(n)
        for c, n in (
            ("total_pairings", "total_unique_pairings"),
            ("fail_normal", "total_failing_normal"),
            ("fail_large", "total_failing_large"),
        )
    ]
    buckets = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in BUCKETS]), F.array(*[c for _, c in _bucket_counts()])
    )
    return masked.agg(
        F.lit(crawl).alias("crawl_id"),
        *_corpus_columns(),
        *sums,
        *_rate_columns(),
        *shares,
        buckets.alias("pass_rate_distribution"),
        F.min("worst_ratio").alias("min_worst_ratio_across_sites"),
    )


def _gathered(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """A short list of rows as one row with one sorted array."""
    fields = F.struct(*[F.col(c) for c in rows.columns])
    ranked = rows.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], fields.alias("v")).alias("r"))
    listed = F.array_sort(F.collect_list("r"))
    return ranked.agg(F.transform(listed, lambda r: r.getField("v")).alias(name))


def audit_summary(results: DataFrame, crawl: str) -> DataFrame:
    """The corpus summary as one row of scalars, maps and short lists.

    ``results`` is read several times: pass a stored table. The parts are rows
    of one union folded by an aggregate, so no part is joined to another.
    """
    categories = _gathered(category_rollup(results), "categories", [F.col("category")])
    worst = _gathered(
        worst_offenders(results), "worst_offenders", [F.col("pass_rate_normal"), F.col("domain")]
    )
    compliant = _gathered(
        fully_compliant_sites(results),
        "fully_compliant_sites",
        [-F.col("total_pairings"), F.col("domain")],
    )
    parts = [_corpus_row(results, crawl), categories, worst, compliant]
    names = [c for part in parts for c in part.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = rows.agg(*[F.any_value(c, True).alias(c) for c in names])
    entries = F.transform(
        "categories",
        lambda c: F.struct(
            c.getField("category").alias("key"),
            F.struct(
                *[
                    c.getField(f).alias(f)
                    for f in ("count", "avg_pass_rate", "median_pass_rate", "fully_compliant", "below_50_pct")
                ]
            ).alias("value"),
        ),
    )
    return folded.withColumn("categories", F.map_from_entries(entries)).withColumnRenamed(
        "categories", "category_analysis"
    )


def summary_empty_guard(summary: DataFrame) -> DataFrame:
    """Replace a summary of no coloured site by the error message."""
    empty = F.coalesce(F.col("domains_with_color_data"), F.lit(0)) == 0
    kept = [F.when(~empty, F.col(c)).alias(c) for c in summary.columns]
    return summary.select(*kept, F.when(empty, NO_COLOUR_MESSAGE).alias("error"))


def compliance_flags(results: DataFrame) -> DataFrame:
    """Add the Yes/No columns; they follow the rounded rates."""

    def flag(rate: str) -> Column:
        return F.when(F.col(rate) == 100, "Yes").otherwise("No")

    return results.withColumns(
        {
            "fully_compliant_normal": flag("pass_rate_normal"),
            "fully_compliant_large": flag("pass_rate_large"),
        }
    )


def report_rank(rows: DataFrame) -> DataFrame:
    """Add the 1-based ``rank`` by domain without bringing the rows to one task.

    A range-partitioned sort numbers rows within partitions; each partition's
    offset, one row per partition, completes the number. The sorted rows are
    stored first, so both reads see the same partitions.
    """
    at = F.monotonically_increasing_id()
    numbered = rows.orderBy("domain").withColumn("__at", at)
    stored = materialised(numbered)
    part = F.shiftright("__at", 33).alias("__part")
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("__part", F.shiftright("__at", 33))
        .join(F.broadcast(offsets), "__part")
        .select((F.col("__before") + local + 1).alias("rank"), *rows.columns)
    )


def audit_report(results: DataFrame) -> DataFrame:
    """The 15 report columns of every site with colours, ranked by domain."""
    sites = compliance_flags(filter_with_colours(results)).withColumn(
        "category", categorise_domain(F.col("domain"))
    )
    return report_rank(
        sites.select(
            "domain",
            "category",
            "total_pairings",
            "pass_normal",
            "fail_normal",
            "pass_rate_normal",
            "pass_large",
            "fail_large",
            "pass_rate_large",
            "worst_ratio",
            "median_ratio",
            "mean_ratio",
            "fully_compliant_normal",
            "fully_compliant_large",
        )
    )

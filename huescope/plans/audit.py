"""Whole-page analysis without a shuffle.

A page is one row and all of its pairings come from that row, so everything
from tokens to page statistics is computed inside the row with array functions.
The job is a single narrow stage: no exchange to skew, nothing to spill, and a
lost executor costs only the pages it was reading. The row operators in
``huescope.operators.pairings`` serve inputs that already are one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.functions import css, html
from huescope.functions.colours import (
    BLACK,
    LARGE_TEXT_MINIMUM,
    NORMAL_TEXT_MINIMUM,
    UNREADABLE,
    WHITE,
    channels,
    ratio_of_luminances,
    relative_luminance,
    unreadable_message,
)
from huescope.functions.frames import settled
from huescope.functions.numeric import percent, round_half_even
from huescope.functions.text import newlines
from huescope.operators.pairings import ASSUMED_BACKGROUND, ASSUMED_FOREGROUND, WORST_PER_PAGE

def _rule_list(tokens: Column) -> Column:
    """ARRAY<STRUCT<selector, body>>: style sheets first, then inline styles."""
    sheets = F.flatten(
        F.transform(
            F.filter(tokens, html.may_be_style_element), lambda t: css.rules(html.style_text(t))
        )
    )
    inline = F.transform(
        F.filter(tokens, html.may_have_style_attribute),
        lambda t: F.struct(
            F.lit(css.INLINE_SELECTOR).alias("selector"), html.style_attribute(t).alias("body")
        ),
    )
    return F.filter(
        F.concat(sheets, inline),
        lambda r: F.coalesce(css.has_colour_property(r.getField("body")), F.lit(False)),
    )


def _declaration_list(rules: Column) -> Column:
    """ARRAY<STRUCT<selector, color, background, fg, bg, failing>>.

    ``failing``: the shorthand value that cannot be read, if any.
    """
    properties = F.transform(
        rules,
        lambda r: F.struct(
            r.getField("selector").alias("selector"),
            css.colour_properties(r.getField("body")).alias("p"),
        ),
    )
    named = F.transform(
        properties,
        lambda d: F.struct(
            d.getField("selector").alias("selector"),
            css.text_colour(d.getField("p")).alias("color"),
            css.background_colour(d.getField("p")).alias("background"),
            css.unreadable_text(d.getField("p")).alias("failing"),
        ),
    )
    coded = F.transform(
        named,
        lambda d: F.struct(
            d.alias("d"), css.colour_pair(d.getField("color"), d.getField("background")).alias("c")
        ),
    )
    return F.transform(
        coded,
        lambda x: F.struct(
            x.getField("d").getField("selector").alias("selector"),
            x.getField("d").getField("color").alias("color"),
            x.getField("d").getField("background").alias("background"),
            F.get(x.getField("c"), F.lit(0)).alias("fg"),
            F.get(x.getField("c"), F.lit(1)).alias("bg"),
            x.getField("d").getField("failing").alias("failing"),
        ),
    )


def _first_failing(declarations: Column) -> Column:
    """The value that fails the page: the first shorthand, or else the first colour of a pair."""

    def colour(d: Column) -> Column:
        return F.when(d.getField("fg") == UNREADABLE, d.getField("color")).when(
            d.getField("bg") == UNREADABLE, d.getField("background")
        )

    shorthands = F.transform(declarations, lambda d: d.getField("failing"))
    colours = F.transform(declarations, colour)
    return F.coalesce(*[F.get(F.filter(x, lambda t: t.isNotNull()), F.lit(0)) for x in (shorthands, colours)])


def _pair_list(declarations: Column) -> Column:
    """Pairs sorted by (pair, seq): equal pairs are neighbours, first one first."""

    def pair(d: Column, at: Column) -> Column:
        fg, bg = d.getField("fg"), d.getField("bg")
        return F.struct(
            F.coalesce(fg, F.lit(BLACK)).alias("fg"),
            F.coalesce(bg, F.lit(WHITE)).alias("bg"),
            at.alias("seq"),
            F.when(fg.isNotNull(), d.getField("color"))
            .otherwise(F.lit(ASSUMED_FOREGROUND))
            .alias("foreground"),
            F.when(bg.isNotNull(), d.getField("background"))
            .otherwise(F.lit(ASSUMED_BACKGROUND))
            .alias("background"),
            (fg.isNotNull() & bg.isNotNull()).alias("explicit"),
            d.getField("selector").alias("selector"),
        )

    coloured = F.filter(declarations, lambda d: d.getField("fg").isNotNull() | d.getField("bg").isNotNull())
    return F.array_sort(F.transform(coloured, pair))


def _distinct_list(pairs: Column) -> Column:
    """First of each run of equal pairs, back in document order, with its ratio."""

    def starts_run(p: Column, at: Column) -> Column:
        before = F.get(pairs, at - 1)
        return (
            (at == 0)
            | (before.getField("fg") != p.getField("fg"))
            | (before.getField("bg") != p.getField("bg"))
        )

    def scored(p: Column) -> Column:
        return F.struct(
            p.getField("seq").alias("seq"),
            p.alias("p"),
            relative_luminance(p.getField("fg")).alias("one"),
            relative_luminance(p.getField("bg")).alias("other"),
        )

    def compared(x: Column) -> Column:
        return F.struct(
            x.getField("p").alias("p"),
            ratio_of_luminances(x.getField("one"), x.getField("other")).alias("exact"),
        )

    def pairing(x: Column) -> Column:
        p, exact = x.getField("p"), x.getField("exact")
        return F.struct(
            p.getField("foreground").alias("foreground"),
            p.getField("background").alias("background"),
            channels(p.getField("fg")).alias("fg_rgb"),
            channels(p.getField("bg")).alias("bg_rgb"),
            round_half_even(exact, 2).alias("ratio"),
            (exact >= NORMAL_TEXT_MINIMUM).alias("pass_normal"),
            (exact >= LARGE_TEXT_MINIMUM).alias("pass_large"),
            p.getField("explicit").alias("explicit"),
            p.getField("selector").alias("selector"),
        )

    scores = F.array_sort(F.transform(F.filter(pairs, starts_run), scored))
    return F.transform(F.transform(scores, compared), pairing)


def page_pairings(pages: DataFrame, key: str = "domain", text: str = "html") -> DataFrame:
    """(key, failed, error, pairings): deduplicated pairings of each page, in discovery order."""
    tokens = pages.select(key, html.style_tokens(newlines(F.coalesce(text, F.lit("")))).alias("tokens"))
    declared = tokens.select(key, _declaration_list(_rule_list(F.col("tokens"))).alias("declarations"))
    judged = settled(
        declared,
        [F.col(key), F.col("declarations")],
        {"failing": _first_failing(F.col("declarations"))},
    )
    failed = F.col("failing").isNotNull()
    paired = judged.select(
        key,
        "failing",
        F.when(failed, F.slice("declarations", 1, 0)).otherwise(F.col("declarations")).alias("declarations"),
    ).select(key, "failing", _pair_list(F.col("declarations")).alias("pairs"))
    return settled(
        paired,
        [F.col(key)],
        {
            "failed": failed,
            # through an array, as the rare message would bloat the code compiled for all pages
            "error": F.when(failed, F.get(F.transform(F.array("failing"), unreadable_message), F.lit(0))),
            "pairings": _distinct_list(F.col("pairs")),
        },
    )


def _statistics() -> dict[str, Column]:
    analysed = ~F.col("failed")

    def known(value: Column) -> Column:
        return F.when(analysed, value.cast("bigint"))

    total = F.size("pairings")
    n_normal = F.size(F.filter("pairings", lambda p: p.getField("pass_normal")))
    n_large = F.size(F.filter("pairings", lambda p: p.getField("pass_large")))
    cents = F.aggregate(
        "ratios", F.lit(0).cast("bigint"), lambda acc, r: acc + F.rint(r * 100.0).cast("bigint")
    )
    mean = cents / F.lit(100.0) / F.when(total > 0, total)
    failing = F.filter("pairings", lambda p: ~p.getField("pass_normal"))
    ranked = F.transform(
        failing, lambda p, at: F.struct(p.getField("ratio").alias("r"), at.alias("at"), p.alias("p"))
    )
    worst = F.transform(F.slice(F.array_sort(ranked), 1, WORST_PER_PAGE), lambda x: x.getField("p"))
    return {
        "status": F.when(analysed, "analysed").otherwise("error"),
        "error": F.col("error"),
        "total_pairings": known(total),
        "pass_normal": known(n_normal),
        "fail_normal": known(total - n_normal),
        "pass_large": known(n_large),
        "fail_large": known(total - n_large),
        "pass_rate_normal": percent(n_normal, total),
        "pass_rate_large": percent(n_large, total),
        "worst_ratio": F.get("ratios", F.lit(0)),
        "best_ratio": F.try_element_at("ratios", F.lit(-1)),
        "median_ratio": F.get("ratios", F.floor(total / 2).cast("int")),
        "mean_ratio": round_half_even(mean, 2),
        "worst_pairings": F.when(total > 0, worst),
        "pairings": F.when(analysed, F.col("pairings")),
    }


def analyse_pages(pages: DataFrame, key: str = "domain", text: str = "html") -> DataFrame:
    """One result row per page, with nested ``pairings`` and ``worst_pairings``."""
    sorted_ratios = F.array_sort(F.transform("pairings", lambda p: p.getField("ratio")))
    rows = page_pairings(pages, key, text).select(
        key, "failed", "error", "pairings", sorted_ratios.alias("ratios")
    )
    return settled(rows, [F.col(key)], _statistics())

"""Pages to colour declarations, one row per rule or inline style.

``seq`` is STRUCT<kind, block, rule>: style elements (kind 0) come before
inline styles (kind 1), each in document order. It decides which of two equal
pairings is kept later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.functions import css, html
from huescope.functions.frames import settled
from huescope.functions.text import newlines


def _tokens(pages: DataFrame, key: str, text: str) -> DataFrame:
    return pages.select(key, F.posexplode(html.style_tokens(newlines(F.col(text)))).alias("block", "token"))


def extract_style_blocks(pages: DataFrame, key: str = "domain", text: str = "html") -> DataFrame:
    """(key, block, css): text of every closed style element."""
    return (
        _tokens(pages, key, text)
        .where(html.is_style_element(F.col("token")))
        .select(key, "block", html.style_text(F.col("token")).alias("css"))
    )


def extract_inline_styles(pages: DataFrame, key: str = "domain", text: str = "html") -> DataFrame:
    """(key, block, style): non-empty style attribute of every start tag."""
    tags = _tokens(pages, key, text).where(html.may_have_style_attribute(F.col("token")))
    found = settled(tags, [F.col(key), F.col("block")], {"style": html.style_attribute(F.col("token"))})
    return found.where(F.length("style") > 0)


def parse_css_rules(blocks: DataFrame, text: str = "css") -> DataFrame:
    """(..., rule, selector, body): innermost rules of a style sheet."""
    kept = [c for c in blocks.columns if c != text]
    return blocks.select(*kept, F.posexplode(css.rules(F.col(text))).alias("rule", "r")).select(
        *kept, "rule", "r.selector", "r.body"
    )


def parse_declarations(rules: DataFrame, body: str = "body") -> DataFrame:
    """Add color, background, unreadable and the ``failing`` shorthand value; drops the body.

    Rules that set neither are kept here; see ``filter_declarations``.
    """
    kept = [F.col(c) for c in rules.columns if c != body]
    split = rules.select(*kept, css.colour_properties(F.col(body)).alias("__p"))
    properties = F.col("__p")
    return settled(
        split,
        kept,
        {
            "color": css.text_colour(properties),
            "background": css.background_colour(properties),
            "unreadable": css.unreadable(properties),
            "failing": css.unreadable_text(properties),
        },
    )


def declares_colour() -> Column:
    return F.col("color").isNotNull() | F.col("background").isNotNull() | F.col("unreadable")


def filter_declarations(declarations: DataFrame) -> DataFrame:
    """Keep rules that set a colour, or that make their page fail."""
    return declarations.where(declares_colour())


def inline_declarations(pages: DataFrame, key: str = "domain", text: str = "html") -> DataFrame:
    """Declarations of style attributes only."""
    styles = extract_inline_styles(pages, key, text)
    coloured = styles.where(css.has_colour_property(F.col("style")))
    return filter_declarations(parse_declarations(coloured, "style")).select(
        key,
        F.struct(F.lit(1).alias("kind"), "block", F.lit(0).alias("rule")).alias("seq"),
        F.lit(css.INLINE_SELECTOR).alias("selector"),
        "color",
        "background",
        "unreadable",
        "failing",
    )


def union_declarations(
    pages: DataFrame, key: str = "domain", text: str = "html", every_page: bool = False
) -> DataFrame:
    """Declarations of style elements and of style attributes in one pass.

    ``seq`` puts the rules of style elements first, whatever their place. With
    ``every_page`` each page row also gives one row without colours, of kind -1,
    so that statistics by page need no second look at the pages.
    """
    tokens = html.style_tokens(newlines(F.col(text)))
    if every_page:  # a token that is no text stands for the page, before all others
        tokens = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(tokens, F.array().cast("array<string>")))
    found = pages.select(key, F.posexplode(tokens).alias("block", "token"))
    token, stands = F.col("token"), F.col("token").isNull()

    def entry(kind: int, rule: Column, selector: Column, body: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), rule.alias("rule"), selector.alias("selector"), body.alias("body")
        )

    sheet = F.transform(
        css.rules(html.style_text(token)),
        lambda r, at: entry(0, at, r.getField("selector"), r.getField("body")),
    )
    attribute = F.array(entry(1, F.lit(0), F.lit(css.INLINE_SELECTOR), html.style_attribute(token)))
    whole_page = F.array(entry(-1, F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string")))
    is_sheet, is_styled = html.may_be_style_element(token), html.may_have_style_attribute(token)
    listed = F.when(is_sheet & is_styled, F.concat(sheet, attribute)).when(is_sheet, sheet)
    if every_page:
        listed = listed.when(stands, whole_page)
    rows = found.where(is_sheet | is_styled | stands).select(key, "block", F.inline(listed.otherwise(attribute)))
    is_page = F.col("kind") < 0
    coloured = rows.where(css.has_colour_property(F.col("body")) | is_page)
    parsed = parse_declarations(coloured)
    kept = parsed.where(declares_colour() | is_page) if every_page else filter_declarations(parsed)
    return kept.select(
        key,
        F.struct("kind", "block", "rule").alias("seq"),
        "selector",
        "color",
        "background",
        "unreadable",
        "failing",
    )

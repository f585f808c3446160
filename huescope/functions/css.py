"""Style sheets as column expressions: comments, rules, colour properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huescope.functions.colours import NAMED_COLOURS, UNREADABLE, colour_code_of, colour_codes
from huescope.functions.text import WS, strip

# An unclosed comment stays: its second alternative keeps the rest of the text
# in one step, so a text full of comment openings is still read once.
_COMMENT = r"(?s)/\*.*?\*/|(/\*.*+)"

# "prelude{body}" without braces inside either part. A match can only start
# where a run of non-brace characters starts; the look-behind says so and keeps
# the scan linear.
_RULE = r"(?<![^{}])[^{}]++\{[^{}]*+\}"

_PROPERTY = rf"(?is)(?:^|;){WS}*+((?:color|background(?:-color)?){WS}*+:[^;]*+)"
_IMPORTANT = rf"(?i)(?<!{WS}){WS}*+!important\z"
_HEX_TOKEN = r"(#[0-9a-fA-F]{3,8})\b"
# The second alternative swallows an unclosed call, which cannot match later.
_FUNCTION_TOKEN = r"(?i)((?:rgb|hsl)a?\s*+\([^)]++\))|(?:rgb|hsl)a?\s*+\([^)]++\z"
_NAME_TOKEN = rf"(?:^|{WS})({'|'.join(NAMED_COLOURS)})(?={WS}|\z)"

INLINE_SELECTOR = "[inline]"


def strip_comments(css: Column) -> Column:
    return F.regexp_replace(css, _COMMENT, "$1")


def rules(css: Column) -> Column:
    """ARRAY<STRUCT<selector, body>> of the innermost rules, in text order."""
    found = F.regexp_extract_all(strip_comments(css), F.lit(_RULE), F.lit(0))
    return F.transform(
        found,
        lambda r: F.struct(
            strip(F.substring_index(r, "{", 1)).alias("selector"),
            F.replace(F.substring_index(r, "{", -1), F.lit("}"), F.lit("")).alias("body"),
        ),
    )


def has_colour_property(body: Column) -> Column:
    return body.rlike(_PROPERTY)


def _property_value(prop: Column) -> Column:
    text = strip(F.regexp_extract(prop, r"(?s)^[^:]*+:(.*)", 1))
    return F.regexp_replace(text, _IMPORTANT, "")


def shorthand_colour(value: Column) -> Column:
    """First colour-like token of a ``background`` value that is no colour itself."""
    return F.coalesce(
        F.nullif(F.regexp_extract(value, _HEX_TOKEN, 1), F.lit("")),
        F.nullif(F.regexp_extract(value, _FUNCTION_TOKEN, 1), F.lit("")),
        F.nullif(F.regexp_extract(F.lower(value), _NAME_TOKEN, 1), F.lit("")),
    )


def colour_properties(body: Column) -> Column:
    """ARRAY<STRUCT<is_text, value, unreadable>> of the colour properties in order.

    ``value`` is NULL for a ``background`` without any colour token.
    """
    found = F.regexp_extract_all(body, F.lit(_PROPERTY), F.lit(1))
    split = F.transform(
        found,
        lambda p: F.struct(
            p.rlike("(?i)^color").alias("is_text"),
            p.rlike("(?i)^background(?!-)").alias("is_shorthand"),
            _property_value(p).alias("value"),
        ),
    )
    judged = F.transform(
        split,
        lambda p: F.struct(
            p.getField("is_text").alias("is_text"),
            p.getField("is_shorthand").alias("is_shorthand"),
            p.getField("value").alias("value"),
            F.when(p.getField("is_shorthand"), colour_code_of(p.getField("value"))).alias("whole"),
        ),
    )
    return F.transform(
        judged,
        lambda p: F.struct(
            p.getField("is_text").alias("is_text"),
            F.when(
                p.getField("is_shorthand") & p.getField("whole").isNull(),
                shorthand_colour(p.getField("value")),
            )
            .otherwise(p.getField("value"))
            .alias("value"),
            F.coalesce(p.getField("whole") == UNREADABLE, F.lit(False)).alias("unreadable"),
        ),
    )


def _last(properties: Column, wanted) -> Column:
    value = F.try_element_at(F.filter(properties, wanted), F.lit(-1)).getField("value")
    return F.nullif(value, F.lit(""))


def text_colour(properties: Column) -> Column:
    """The last ``color`` value; an empty one counts as absent."""
    return _last(properties, lambda p: p.getField("is_text"))


def background_colour(properties: Column) -> Column:
    """The last background value that names a colour or is a long-hand."""
    return _last(properties, lambda p: ~p.getField("is_text") & p.getField("value").isNotNull())


def unreadable(properties: Column) -> Column:
    return F.exists(properties, lambda p: p.getField("unreadable"))


def unreadable_text(properties: Column) -> Column:
    """The first ``background`` value that cannot be read, NULL if there is none."""
    return F.get(F.filter(properties, lambda p: p.getField("unreadable")), F.lit(0)).getField("value")


def colour_pair(color: Column, background: Column) -> Column:
    """Colour codes of both values as ARRAY<INT>."""
    return colour_codes(F.array(color, background))

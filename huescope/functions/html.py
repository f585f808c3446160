"""HTML tokens that carry styles, found by one regular expression pass.

Possessive quantifiers keep the matcher iterative and linear on long tags, and
every alternative may run to the end of the text, so an unclosed construct is
read once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huescope.functions.text import unescape

_VALUE = r"""'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+"""
_ATTRIBUTE = rf"[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:{_VALUE}))?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
# The rest of a start tag that does not close itself; a slash that ends an unquoted
# value belongs to the value.
_NOT_CLOSED = rf"(?:[\s/]*+{_ATTRIBUTE})*+(?:[\s/]++(?<!/))?+>"

# Group 1 is set for the tokens of interest only: style elements with their
# text, start tags with a style attribute, and script elements that have one.
_TOKEN = (
    r"(?is)(?=<)(?:<!--.*?(?:--\s*+>|\z)"
    rf"|<script(?=[\s/>])(?![^>]*\sstyle){_NOT_CLOSED}.*?(?:</\s*+script\s*+>|\z)"
    rf"|<(?!(?:script|style)[\s/>])[a-z][^\s/>]*+(?:[\s/]++|(?!style[\s=/>]){_ATTRIBUTE})*+(?:>|\z)"
    rf"|(<(script|style)(?=[\s/>]){_NOT_CLOSED}.*?(?:</\s*+\2\s*+>|\z)"
    rf"|<[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z))"
    r"|<[!/?][^>]*+(?:>|\z))"
)
_STYLE_ELEMENT = rf"(?is)^<style(?=[\s/>]){_NOT_CLOSED}(.*)</\s*+style\s*+>\z"
_START_TAG = rf"(?is)^<[a-z][^\s/>]*+{_ATTRIBUTES}>"

# Walks the attributes; group 1 is the value of a style attribute.
_STYLE_ATTRIBUTE = (
    rf"(?is)(?<![^\s/'\"])style\s*+=++\s*+({_VALUE})"
    rf"|{_ATTRIBUTE}"
)
_MAY_HAVE_STYLE_ATTRIBUTE = r"(?i)[\s/'\"]style\s*+="


def style_tokens(html: Column) -> Column:
    """ARRAY<STRING> of style elements and styled start tags in document order."""
    return F.array_remove(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1)), F.lit(""))


def is_style_element(token: Column) -> Column:
    """True for a closed style element; an unclosed one is dropped."""
    return token.rlike(_STYLE_ELEMENT)


def may_be_style_element(token: Column) -> Column:
    """Cheap test; ``style_text`` of an unclosed element is empty."""
    return token.rlike(r"(?i)^<style[\s/>]")


def style_text(token: Column) -> Column:
    return F.regexp_extract(token, _STYLE_ELEMENT, 1)


def may_have_style_attribute(token: Column) -> Column:
    return token.rlike(_MAY_HAVE_STYLE_ATTRIBUTE)


def style_attribute(token: Column) -> Column:
    """Value of the last style attribute of a start tag, NULL if there is none."""
    tag = F.regexp_extract(token, _START_TAG, 0)
    values = F.array_remove(F.regexp_extract_all(tag, F.lit(_STYLE_ATTRIBUTE), F.lit(1)), F.lit(""))
    bare = F.regexp_replace(F.try_element_at(values, F.lit(-1)), r"""(?s)^(['"])(.*)\1\z""", "$2")
    return unescape(bare)

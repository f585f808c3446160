"""Whitespace and character-reference handling for CSS and HTML text."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as white space.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

WS_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(WS, chr(c)))

# Named references to the characters that style sheets are made of, from the standard's
# table; those of the first HTML also count without their semicolon.
_NAMED = {n: c for n, c in html5.items() if len(c) == 1 and (ord(c) < 128 or ord(c) == 0xA0)}
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)
_CLOSED = [n for n in _NAMED if n.endswith(";")]

# Numeric references to this range mean its Windows-1252 characters, where there are any.
_C1 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))

_REFERENCE = rf"(?s)&#(?:[xX][0-9a-fA-F]+|[0-9]+);?|&(?:{'|'.join(_CLOSED)})|&(?:{'|'.join(_BARE)})(?![0-9A-Za-z=])"
_PIECES = rf"{_REFERENCE}|[^&]+|&"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(text, F.lit(WS_CHARS))


def _code_point_text(reference: Column) -> Column:
    """The character of a numeric reference; U+FFFD where there is none."""
    digits = F.regexp_extract(reference, r"(?i)^&#x?0*([0-9a-f]*);?$", 1)
    is_hex = reference.rlike("(?i)^&#x")
    value = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    # without leading zeros, more than eight digits are beyond every code point
    point = F.when(F.length(digits) <= 8, value).cast("bigint")
    valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    encoded = F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0"))
    remapped = F.when(point.between(0x80, 0x9F), F.substring(F.lit(_C1), (point - 0x7F).cast("int"), F.lit(1)))
    return F.coalesce(remapped, F.decode(encoded, "UTF-32"), F.lit("\ufffd"))


def _resolved(piece: Column) -> Column:
    named = F.create_map(*[F.lit(x) for name, c in _NAMED.items() for x in (f"&{name}", c)])
    return F.when(piece.startswith("&#"), _code_point_text(piece)).when(
        piece.startswith("&"), F.coalesce(F.element_at(named, piece), piece)
    ).otherwise(piece)


def unescape(text: Column) -> Column:
    """Resolve numeric references and the named ones of ASCII characters, each once."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _resolved), "")).otherwise(text)


def newlines(text: Column) -> Column:
    """Every kind of line end as a line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")

"""Archived responses as column expressions: header blocks, character set, chunking.

Bytes stay bytes: positions are found in the ISO-8859-1 reading, which has one
character for each byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huescope.functions.text import strip

_BLANK_LINES = ("\r\n\r\n", "\n\n")


def _end_of_block(text: Column) -> tuple[Column, Column]:
    """Where the first header block ends and what follows it begins (from 1); NULL without a blank line.

    The first blank line of carriage returns counts, and only without any the
    first of line feeds alone.
    """
    strict, loose = (F.instr(text, blank) for blank in _BLANK_LINES)
    end = F.when(strict > 0, strict).when(loose > 0, loose)
    return end, end + F.when(strict > 0, 4).otherwise(2)


def response(record: Column) -> Column:
    """What follows the archive's own headers, a character for each byte; NULL if they have no end."""
    text = F.decode(record, "ISO-8859-1")
    _, after = _end_of_block(text)
    return F.substring(text, after, F.length(text))


def header_block(rest: Column) -> Column:
    """The response's header lines in lower case, NULL if their block has no end."""
    end, _ = _end_of_block(rest)
    head = F.encode(F.substring(rest, F.lit(1), end - 1), "ISO-8859-1")
    return F.lower(F.make_valid_utf8(head.cast("string")))


def header_fields(block: Column) -> Column:
    """MAP<STRING, ARRAY<STRING>> of a lower-case header block: each name with its values in order."""
    pairs = F.transform(
        F.split(block, "\n"),
        lambda line: F.struct(
            F.substring_index(line, ":", 1).alias("name"),
            F.when(line.contains(":"), F.substring(line, F.instr(line, ":") + 1, F.length(line)))
            .otherwise("")
            .alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p.getField("name")))
    values = F.transform(
        names,
        lambda name: F.transform(
            F.filter(pairs, lambda p: p.getField("name") == name), lambda p: p.getField("value")
        ),
    )
    return F.map_from_arrays(names, values)


def charset(fields: Column) -> Column:
    """What the first content type that names a character set names last; else UTF-8."""
    named = F.filter(F.try_element_at(fields, F.lit("content-type")), lambda v: v.contains("charset="))
    first = F.get(named, F.lit(0))
    value = strip(F.rtrim(strip(F.substring_index(first, "charset=", -1)), F.lit(";")))
    return F.when(fields.isNotNull(), F.coalesce(value, F.lit("utf-8")))


def is_chunked(block: Column, fields: Column, anchored: bool = False) -> Column:
    """Whether a response says that its body is chunked.

    By default any header line that ends in the words counts, so
    ``X-Transfer-Encoding: chunked`` does too; ``anchored`` asks for the header of
    that very name and takes its last coding, whatever the spacing.
    """
    if not anchored:
        return block.contains("transfer-encoding: chunked")
    codings = F.coalesce(F.try_element_at(fields, F.lit("transfer-encoding")), F.array().cast("array<string>"))
    last = F.exists(codings, lambda v: strip(F.element_at(F.split(v, ","), -1)) == F.lit("chunked"))
    return F.when(fields.isNotNull(), last)

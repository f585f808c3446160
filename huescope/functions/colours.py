"""CSS colour syntaxes as column expressions.

A parsed colour travels as one INT, the *colour code*:

* ``0xRRGGBB``  the colour,
* NULL          the text is not a colour,
* ``UNREADABLE`` the text makes the whole page fail (a ``#`` value of a
  colour's length with a non-hexadecimal digit, or an infinite rgb channel).

The same parsing steps serve rows (``with_colour_code``, inside whole-stage code
generation) and arrays (``colour_codes``, for the in-row page analysis).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huescope.functions.frames import settled
from huescope.functions.text import WS_CHARS, strip

UNREADABLE = -1
WHITE = 0xFFFFFF
BLACK = 0x000000
NORMAL_TEXT_MINIMUM = 4.5
LARGE_TEXT_MINIMUM = 3.0

# The CSS named colours, "name red green blue".
_NAMED_TEXT = """
aliceblue 240 248 255
antiquewhite 250 235 215
aqua 0 255 255
aquamarine 127 255 212
azure 240 255 255
beige 245 245 220
bisque 255 228 196
black 0 0 0
blanchedalmond 255 235 205
blue 0 0 255
blueviolet 138 43 226
brown 165 42 42
burlywood 222 184 135
cadetblue 95 158 160
chartreuse 127 255 0
chocolate 210 105 30
coral 255 127 80
cornflowerblue 100 149 237
cornsilk 255 248 220
crimson 220 20 60
cyan 0 255 255
darkblue 0 0 139
darkcyan 0 139 139
darkgoldenrod 184 134 11
darkgray 169 169 169
darkgreen 0 100 0
darkgrey 169 169 169
darkkhaki 189 183 107
darkmagenta 139 0 139
darkolivegreen 85 107 47
darkorange 255 140 0
darkorchid 153 50 204
darkred 139 0 0
darksalmon 233 150 122
darkseagreen 143 188 143
darkslateblue 72 61 139
darkslategray 47 79 79
darkslategrey 47 79 79
darkturquoise 0 206 209
darkviolet 148 0 211
deeppink 255 20 147
deepskyblue 0 191 255
dimgray 105 105 105
dimgrey 105 105 105
dodgerblue 30 144 255
firebrick 178 34 34
floralwhite 255 250 240
forestgreen 34 139 34
fuchsia 255 0 255
gainsboro 220 220 220
ghostwhite 248 248 255
gold 255 215 0
goldenrod 218 165 32
gray 128 128 128
green 0 128 0
greenyellow 173 255 47
grey 128 128 128
honeydew 240 255 240
hotpink 255 105 180
indianred 205 92 92
indigo 75 0 130
ivory 255 255 240
khaki 240 230 140
lavender 230 230 250
lavenderblush 255 240 245
lawngreen 124 252 0
lemonchiffon 255 250 205
lightblue 173 216 230
lightcoral 240 128 128
lightcyan 224 255 255
lightgoldenrodyellow 250 250 210
lightgray 211 211 211
lightgreen 144 238 144
lightgrey 211 211 211
lightpink 255 182 193
lightsalmon 255 160 122
lightseagreen 32 178 170
lightskyblue 135 206 250
lightslategray 119 136 153
lightslategrey 119 136 153
lightsteelblue 176 196 222
lightyellow 255 255 224
lime 0 255 0
limegreen 50 205 50
linen 250 240 230
magenta 255 0 255
maroon 128 0 0
mediumaquamarine 102 205 170
mediumblue 0 0 205
mediumorchid 186 85 211
mediumpurple 147 111 219
mediumseagreen 60 179 113
mediumslateblue 123 104 238
mediumspringgreen 0 250 154
mediumturquoise 72 209 204
mediumvioletred 199 21 133
midnightblue 25 25 112
mintcream 245 255 250
mistyrose 255 228 225
moccasin 255 228 181
navajowhite 255 222 173
navy 0 0 128
oldlace 253 245 230
olive 128 128 0
olivedrab 107 142 35
orange 255 165 0
orangered 255 69 0
orchid 218 112 214
palegoldenrod 238 232 170
palegreen 152 251 152
paleturquoise 175 238 238
palevioletred 219 112 147
papayawhip 255 239 213
peachpuff 255 218 185
peru 205 133 63
pink 255 192 203
plum 221 160 221
powderblue 176 224 230
purple 128 0 128
rebeccapurple 102 51 153
red 255 0 0
rosybrown 188 143 143
royalblue 65 105 225
saddlebrown 139 69 19
salmon 250 128 114
sandybrown 244 164 96
seagreen 46 139 87
seashell 255 245 238
sienna 160 82 45
silver 192 192 192
skyblue 135 206 235
slateblue 106 90 205
slategray 112 128 144
slategrey 112 128 144
snow 255 250 250
springgreen 0 255 127
steelblue 70 130 180
tan 210 180 140
teal 0 128 128
thistle 216 191 216
tomato 255 99 71
turquoise 64 224 208
violet 238 130 238
wheat 245 222 179
white 255 255 255
whitesmoke 245 245 245
yellow 255 255 0
yellowgreen 154 205 50
"""

NAMED_COLOURS: dict[str, int] = {
    name: int(red) << 16 | int(green) << 8 | int(blue)
    for name, red, green, blue in (row.split() for row in _NAMED_TEXT.split("\n") if row)
}

# Numbers as a colour function accepts them: digit groups may carry "_".
_NUMBER = (
    r"^[+-]?(?:\d+(?:_\d+)*+\.?(?:\d+(?:_\d+)*+)?|\.\d+(?:_\d+)*+)(?:e[+-]?\d+(?:_\d+)*+)?\z"
    r"|^[+-]?inf(?:inity)?\z"
)
_SEPARATORS = ",/" + WS_CHARS
_HEX_PAIR = r"(?:[0-9a-f]{2}|[\s+][0-9a-f]|[0-9a-f]\s)"
_HEX_PAIRS = rf"^{_HEX_PAIR}{{3}}\z"


def channel_linear(channel: int) -> float:
    """sRGB transfer function of one 8-bit channel."""
    c = channel / 255.0
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def _named_map() -> Column:
    return F.expr("map(" + ",".join(f"'{n}',{rgb}" for n, rgb in NAMED_COLOURS.items()) + ")")


def _linear_table() -> Column:
    # A table, not pow(): the JVM's pow differs from C's in the last place for
    # some inputs, and a lookup is cheaper.
    return F.expr("array(" + ",".join(f"{channel_linear(c)!r}D" for c in range(256)) + ")")


def pack(red: Column, green: Column, blue: Column) -> Column:
    return F.shiftleft(red, 16).bitwiseOR(F.shiftleft(green, 8)).bitwiseOR(blue)


def red(code: Column) -> Column:
    return F.shiftright(code, 16).bitwiseAND(255)


def green(code: Column) -> Column:
    return F.shiftright(code, 8).bitwiseAND(255)


def blue(code: Column) -> Column:
    return code.bitwiseAND(255)


def channels(code: Column) -> Column:
    """The code as ARRAY<INT> of three channels, NULL when there is no colour."""
    return F.when(code >= 0, F.array(red(code), green(code), blue(code)))


def to_number(text: Column) -> Column:
    """Text to DOUBLE, NULL when it is not a number."""
    return F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))


def normalised(text: Column) -> Column:
    return F.lower(strip(text))


# --- the parsing steps -------------------------------------------------------
# Each step maps named columns to named columns. A name read more than once by
# the next step is then an attribute there and not a repeated expression.


def _cut(norm: Column) -> dict[str, Column]:
    """``digits``: six hexadecimal digits of a ``#`` value (short forms doubled),
    NULL when the length is no colour's. ``args``: arguments of rgb()/hsl()."""
    body = F.ltrim(norm, F.lit("#"))
    length = F.length(body)
    digits = F.when(
        length.isin(3, 4), F.regexp_replace(F.substring(body, 1, 3), "(?s)(.)", "$1$1")
    ).when(length.isin(6, 8), F.substring(body, 1, 6))
    inner = F.regexp_extract(norm, r"^(?:rgb|hsl)a?\s*+\(([^)]+)\)", 1)
    return {
        "norm": norm,
        "digits": F.when(norm.startswith("#"), digits),
        "args": F.when(
            norm.startswith("rgb") | norm.startswith("hsl"),
            F.split(F.trim(F.translate(inner, _SEPARATORS, " " * len(_SEPARATORS))), " +"),
        ),
    }


def _hex_code(digits: Column) -> Column:
    def pair(at: int) -> Column:
        return F.conv(F.regexp_replace(F.substring(digits, at, 2), r"[\s+]", ""), 16, 10).cast("int")

    return (
        F.when(digits.isNull(), None)
        .when(digits.rlike(r"^[0-9a-f]{6}\z"), F.conv(digits, 16, 10).cast("int"))
        .when(digits.rlike(_HEX_PAIRS), pack(pair(1), pair(3), pair(5)))
        .otherwise(UNREADABLE)
    )


def _parts(norm: Column, digits: Column, args: Column) -> dict[str, Column]:
    """Syntax, ``code`` of hex and named colours, the three arguments."""
    fixed = args.isNull()
    return {
        "syntax": F.when(fixed, 0).when(norm.startswith("hsl"), 2).otherwise(1),
        "code": F.when(norm.startswith("#"), _hex_code(digits)).when(
            fixed, F.try_element_at(_named_map(), norm)
        ),
        # fewer than three arguments are no colour, whatever they are
        **{f"p{i}": F.when(F.size(args) >= 3, F.get(args, F.lit(i))) for i in range(3)},
    }


def _texts(syntax: Column, code: Column, *part: Column) -> dict[str, Column]:
    """Number text ``t`` and ``unit`` of each argument."""
    is_rgb, is_hsl = syntax == 1, syntax == 2
    columns = {"syntax": syntax, "code": code}
    for i, p in enumerate(part):
        bare = F.replace(p, F.lit("%"), F.lit("")) if i else F.regexp_replace(p, "deg|turn|rad", "")
        unit = F.lit("share") if i else F.when(p.contains("turn"), "turn").when(p.contains("rad"), "rad")
        columns[f"t{i}"] = F.when(is_rgb, F.regexp_replace(p, r"%\z", "")).when(is_hsl, bare)
        columns[f"unit{i}"] = F.when(is_hsl, unit).when(p.endswith("%"), "%")
    return columns


def _infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(math.inf)


def _channel_code(r: Column, g: Column, b: Column) -> Column:
    """Truncate and clamp three known levels."""

    def clamped(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)).cast("int")

    return pack(clamped(r), clamped(g), clamped(b))


def _rgb_code(r: Column, g: Column, b: Column) -> Column:
    return (
        F.when(r.isNull(), None)
        .when(_infinite(r), UNREADABLE)
        .when(g.isNull(), None)
        .when(_infinite(g), UNREADABLE)
        .when(b.isNull(), None)
        .when(_infinite(b), UNREADABLE)
        .otherwise(_channel_code(r, g, b))
    )


def _hsl_terms(hue: Column, saturation: Column, lightness: Column) -> dict[str, Column]:
    """What the channels are mixed from; NULL when an argument is NULL or not finite."""
    known = ~(_infinite(hue) | _infinite(saturation) | _infinite(lightness))
    chroma = (F.lit(1.0) - F.abs(F.lit(2.0) * lightness - F.lit(1.0))) * saturation
    return {
        "chroma": F.when(known, chroma),
        "offset": lightness - chroma / F.lit(2.0),
        "turn": F.when(known, F.pmod(hue, F.lit(360.0)) / F.lit(60.0)),
    }


def _hsl_code(chroma: Column, offset: Column, turn: Column) -> Column:
    """The channels of one sixth of the circle, rounded half-even."""
    side = F.lit(1.0) - F.abs(F.pmod(turn, F.lit(2.0)) - F.lit(1.0))
    sextant = F.floor(turn).cast("int")
    full, none = F.lit(1.0), F.lit(0.0)

    def level(*weights: Column) -> Column:
        weight = F.when(sextant == 0, weights[0])
        for n, w in enumerate(weights[1:], 1):
            weight = weight.when(sextant == n, w)
        return F.rint((chroma * weight + offset) * F.lit(255.0))

    return F.when(
        chroma.isNotNull(),
        _channel_code(
            level(full, side, none, none, side, full),
            level(side, full, full, side, none, none),
            level(none, none, side, full, full, side),
        ),
    )


def hsl_to_rgb(hue: Column, saturation: Column, lightness: Column) -> Column:
    """HSL (degrees, 0..1, 0..1) to a colour code, channels rounded half-even.

    NULL when an argument is NULL or not finite.
    """
    return _hsl_code(**_hsl_terms(hue, saturation, lightness))


def _numbers(syntax: Column, code: Column, *rest: Column) -> dict[str, Column]:
    """The three arguments as numbers."""
    columns = {"syntax": syntax, "code": code}
    for i in range(3):
        columns[f"v{i}"] = to_number(rest[2 * i])
        columns[f"unit{i}"] = rest[2 * i + 1]
    return columns


def _levels(syntax: Column, code: Column, *rest: Column) -> dict[str, Column]:
    """The arguments in channel, degree or 0..1 units."""
    columns = {"syntax": syntax, "code": code}
    for i in range(3):
        number, unit = rest[2 * i], rest[2 * i + 1]
        columns[f"n{i}"] = (
            F.when(unit.isNull(), number)
            .when(unit == "%", number * F.lit(255.0) / F.lit(100.0))
            .when(unit == "share", number / F.lit(100.0))
            .when(unit == "turn", number * F.lit(360.0))
            .when(unit == "rad", number * F.lit(180.0) / F.lit(math.pi))
        )
    return columns


def _fixed(syntax: Column, code: Column, n0: Column, n1: Column, n2: Column) -> dict[str, Column]:
    """``code`` of rgb values too; only hsl is left to convert."""
    rgb = F.when(syntax == 1, _rgb_code(n0, n1, n2)).otherwise(code)
    terms = {name: F.when(syntax == 2, term) for name, term in _hsl_terms(n0, n1, n2).items()}
    return {"syntax": syntax, "code": rgb, **terms}


_STEPS = (
    (("norm",), _cut),
    (("norm", "digits", "args"), _parts),
    (("syntax", "code", "p0", "p1", "p2"), _texts),
    (("syntax", "code", "t0", "unit0", "t1", "unit1", "t2", "unit2"), _numbers),
    (("syntax", "code", "v0", "unit0", "v1", "unit1", "v2", "unit2"), _levels),
    (("syntax", "code", "n0", "n1", "n2"), _fixed),
)
_LAST = ("syntax", "code", "chroma", "offset", "turn")


def _code(syntax: Column, code: Column, chroma: Column, offset: Column, turn: Column) -> Column:
    return F.when(syntax == 2, _hsl_code(chroma, offset, turn)).otherwise(code)


def _direct(norm: Column, other: Column) -> Column:
    """Plain hex digits and names at once; ``other`` is evaluated for the rest only."""
    doubled = F.regexp_replace(norm, r"([0-9a-f])", "$1$1")
    return (
        F.when(norm.rlike(r"^#(?:[0-9a-f]{6}|[0-9a-f]{8})\z"), F.conv(F.substring(norm, 2, 6), 16, 10).cast("int"))
        .when(norm.rlike(r"^#[0-9a-f]{3,4}\z"), F.conv(F.substring(doubled, 2, 6), 16, 10).cast("int"))
        .when(norm.startswith("#") | norm.startswith("rgb") | norm.startswith("hsl"), other)
        .otherwise(F.try_element_at(_named_map(), norm))
    )


def _stepped(norms: Column) -> Column:
    """Colour codes of normalised texts by the parsing steps."""

    def advance(names: tuple[str, ...], step):
        def one(item: Column) -> Column:
            columns = step(*[item.getField(n) for n in names])
            return F.struct(*[c.alias(n) for n, c in columns.items()])

        return one

    items = F.transform(norms, lambda n: F.struct(n.alias("norm")))
    for names, step in _STEPS:
        items = F.transform(items, advance(names, step))
    return F.transform(items, lambda x: _code(*[x.getField(n) for n in _LAST]))


def _code_of(norm: Column) -> Column:
    return _direct(norm, F.get(_stepped(F.array(norm)), F.lit(0)))


def _quoted(text: Column) -> Column:
    """The text as a literal: quotes, backslashes and line ends escaped."""
    shown = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        shown = F.replace(shown, F.lit(raw), F.lit(name))
    single, double = F.lit("'"), F.lit('"')
    plain = F.concat(single, F.replace(shown, single, F.lit("\\'")), single)
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(double, shown, double)).otherwise(plain)


def unreadable_message(text: Column) -> Column:
    """Why an ``UNREADABLE`` value cannot be read: its first bad pair of digits, or an infinite channel.

    Fixed values: the wording of both messages. Control characters other than tab
    and line ends are shown as they are.
    """
    norm = normalised(text)
    digits = _cut(norm)["digits"]
    pairs = [F.substring(digits, at, 2) for at in (1, 3, 5)]
    bad = F.coalesce(*[F.when(~p.rlike(rf"^{_HEX_PAIR}\z"), p) for p in pairs])
    literal = F.concat(F.lit("invalid literal for int() with base 16: "), _quoted(bad))
    return F.when(norm.startswith("#"), literal).otherwise("cannot convert float infinity to integer")


def with_colour_code(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the colour code of a text column; the prefix alone decides the syntax."""
    kept = [F.col(c) for c in df.columns]
    frame = df.select(*kept, normalised(F.col(text)).alias("__norm"))
    return settled(frame, kept, {out: _code_of(F.col("__norm"))})


def with_colour_code_once(df: DataFrame, text: str, out: str) -> DataFrame:
    """``with_colour_code`` through a dictionary: each different text is parsed once.

    For wide tables in which texts repeat. Map tasks fold equal texts before they
    are shuffled. A small dictionary is broadcast by its size at run time; with a
    large one a text that fills a third of the rows meets one dictionary row, and
    adaptive execution splits those rows over tasks.
    """
    texts = df.select(F.col(text).alias("__text")).where(F.col(text).isNotNull()).distinct()
    parsed = with_colour_code(texts, "__text", "__code")
    joined = df.join(parsed, F.col(text) == F.col("__text"), "left")
    return joined.select(*df.columns, F.col("__code").alias(out))


def colour_codes(texts: Column) -> Column:
    """ARRAY<STRING> to ARRAY<INT> of colour codes."""
    return F.transform(F.transform(texts, normalised), _code_of)


def colour_code_of(text: Column) -> Column:
    """Colour code of one value."""
    return F.get(colour_codes(F.array(text)), F.lit(0))


def parse_colour(text: Column) -> Column:
    """Colour code of a value in any syntax."""
    return colour_code_of(text)


def parse_hex(text: Column) -> Column:
    """Colour code of a ``#`` value, NULL for other syntaxes."""
    return F.when(normalised(text).startswith("#"), colour_code_of(text))


def parse_rgb(text: Column) -> Column:
    """Colour code of an ``rgb()`` / ``rgba()`` value, NULL for other syntaxes."""
    return F.when(normalised(text).startswith("rgb"), colour_code_of(text))


def parse_hsl(text: Column) -> Column:
    """Colour code of an ``hsl()`` / ``hsla()`` value, NULL for other syntaxes."""
    return F.when(normalised(text).startswith("hsl"), colour_code_of(text))


def named_colour(text: Column) -> Column:
    """Colour code of a colour name, NULL for anything else."""
    return F.try_element_at(_named_map(), normalised(text))


def relative_luminance(code: Column) -> Column:
    """Relative luminance of a colour code."""
    table = _linear_table()
    return (
        F.lit(0.2126) * F.get(table, red(code))
        + F.lit(0.7152) * F.get(table, green(code))
        + F.lit(0.0722) * F.get(table, blue(code))
    )


def ratio_of_luminances(one: Column, other: Column) -> Column:
    return (F.greatest(one, other) + F.lit(0.05)) / (F.least(one, other) + F.lit(0.05))


def contrast_ratio(foreground: Column, background: Column) -> Column:
    """Contrast of two colour codes: symmetric, between 1 and 21."""
    return ratio_of_luminances(relative_luminance(foreground), relative_luminance(background))

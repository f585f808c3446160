import pytest
from pyspark.sql import functions as F

from huescope.functions import colours
from huescope.operators.pairings import classify_pairs

COLOURS = {
    "#fff": (255, 255, 255),
    "#000": (0, 0, 0),
    "#f00": (255, 0, 0),
    "#ffffff": (255, 255, 255),
    "#ff6600": (255, 102, 0),
    "#336699": (51, 102, 153),
    "#ff660080": (255, 102, 0),
    "#f008": (255, 0, 0),
    "##0A0b0C": (10, 11, 12),
    "rgb(255, 0, 0)": (255, 0, 0),
    "rgb(0, 128, 255)": (0, 128, 255),
    "rgba(255, 0, 0, 0.5)": (255, 0, 0),
    "rgb(100%, 0%, 0%)": (255, 0, 0),
    "rgb(255 0 0)": (255, 0, 0),
    "rgba(255 0 0 / 0.5)": (255, 0, 0),
    "RGB ( 1e1,+2.9,-3)": (10, 2, 0),
    "rgb(50%, 127.9, 300)": (127, 127, 255),
    "rgb(1_0, 20, 30) trailing": (10, 20, 30),
    "hsl(0, 100%, 50%)": (255, 0, 0),
    "hsl(120, 100%, 50%)": (0, 255, 0),
    "hsl(240, 100%, 50%)": (0, 0, 255),
    "hsl(-120deg, 100%, 50%)": (0, 0, 255),
    "hsl(0.5turn, 100, 50)": (0, 255, 255),
    "hsl(0, 0%, 100%)": (255, 255, 255),
    "hsl(0, 0%, 0%)": (0, 0, 0),
    "hsla(0, 100%, 50%, 0.5)": (255, 0, 0),
    "red": (255, 0, 0),
    " White\t": (255, 255, 255),
    "navy": (0, 0, 128),
    "cornflowerblue": (100, 149, 237),
    "rebeccapurple": (102, 51, 153),
    # eight characters after "#": read as pairs, blanks included
    "#fff 10px": (255, 15, 16),
}
NO_COLOURS = [
    "transparent", "inherit", "currentColor", "initial", "", "  ", "not-a-color", "#12345", "#",
    "hsl(100grad, 50%, 50%)", "rgb(1,2)", "rgb(a,b,c)", "rgb(1,2,nan)", "rgb()", "rgb(1,2,3", "hsl(1,2)",
    "rgb(x, 1e999, 0)", "hsl(inf, 1, 1)", "rgbred", "url(#fff)",
]
UNREADABLE = ["#ggg", "#fff none", "#12345z", "rgb(1e999, 0, 0)", "rgb(0, inf, x)"]


@pytest.mark.parametrize("form", ["rows", "arrays"])
def test_every_syntax(spark, form):
    texts = [*COLOURS, *NO_COLOURS, *UNREADABLE, None]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    if form == "rows":
        coded = colours.with_colour_code(df, "value", "code")
    else:
        coded = df.withColumn("code", colours.parse_colour(F.col("value")))
    rows = coded.select("value", "code", colours.channels(F.col("code")).alias("rgb")).collect()
    found = {r["value"]: r for r in rows}
    assert {t: tuple(found[t]["rgb"] or ()) for t in COLOURS} == COLOURS
    assert [t for t in [*NO_COLOURS, None] if found[t]["code"] is not None] == []
    assert [t for t in UNREADABLE if found[t]["code"] != colours.UNREADABLE] == []


def test_syntax_functions_ignore_other_syntaxes(spark):
    df = spark.createDataFrame([("#fff",), ("rgb(1,2,3)",), ("hsl(0,0%,0%)",), ("tan",)], "v string")
    v = F.col("v")
    row = df.select(
        *[
            F.count(parse(v)).alias(parse.__name__)
            for parse in (colours.parse_hex, colours.parse_rgb, colours.parse_hsl, colours.named_colour)
        ]
    ).first()
    assert tuple(row) == (1, 1, 1, 1)


def test_name_table():
    assert len(colours.NAMED_COLOURS) == 148
    assert all(0 <= v <= 0xFFFFFF for v in colours.NAMED_COLOURS.values())


RATIOS = [
    (0xFFFFFF, 0x000000, 21.0, True, True),
    (0xFFFFFF, 0xFFFFFF, 1.0, False, False),
    (0x767676, 0xFFFFFF, 4.54, True, True),
    (0x777777, 0xFFFFFF, 4.48, False, True),
    (0xFF0000, 0xFFFFFF, 4.0, False, True),
    (0x666666, 0xE0E0E0, 4.35, False, True),
    (0x000000, 0x0072BC, 4.13, False, True),
    (0xD4582A, 0xFFFFFF, 4.02, False, True),
    (0x000000, 0x143352, 1.63, False, False),
    # rounds up to the threshold but does not reach it
    (0x168484, 0xFFFFFF, 4.5, False, True),
]


def test_ratios_and_verdicts(spark):
    df = spark.createDataFrame([(a, b) for a, b, *_ in RATIOS], "fg int, bg int")
    rows = {(r["fg"], r["bg"]): r for r in classify_pairs(df).collect()}
    for fg, bg, ratio, normal, large in RATIOS:
        r = rows[fg, bg]
        assert (r["ratio"], r["pass_normal"], r["pass_large"]) == (ratio, normal, large)


def test_contrast_is_symmetric_and_bounded(spark):
    codes = spark.range(5000).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 24)).cast("int").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 24)).cast("int").alias("b"),
    )
    ratio = colours.contrast_ratio(F.col("a"), F.col("b"))
    back = colours.contrast_ratio(F.col("b"), F.col("a"))
    assert codes.where((ratio != back) | (ratio < 1) | (ratio > 21)).count() == 0


def test_luminance_of_mid_grey(spark):
    row = spark.range(1).select(colours.relative_luminance(F.lit(0x808080)).alias("l")).first()
    assert abs(row["l"] - 0.2159) < 0.001


@pytest.mark.parametrize("value", ["#ggg", "#GGG", "##xyz", "#12345q", "#fff none", "#1x34", "#'ab", '#"ab', "#\\00", "#'\"ab45", "#0\t0 0x", "#é00"])
def test_message_is_that_of_the_first_bad_pair(spark, value):
    digits = value.strip().lower().lstrip("#")
    digits = "".join(c * 2 for c in digits[:3]) if len(digits) < 5 else digits
    problem = None
    for at in (0, 2, 4):
        try:
            int(digits[at : at + 2], 16)
        except ValueError as error:
            problem = problem or str(error)
    row = spark.createDataFrame([(value,)], "v string").select(colours.unreadable_message(F.col("v")), colours.parse_colour(F.col("v"))).first()
    assert tuple(row) == (problem, colours.UNREADABLE)


def test_message_of_an_infinite_channel(spark):
    row = spark.createDataFrame([("rgb(1e999, 1, 2)",)], "v string").select(colours.unreadable_message(F.col("v"))).first()
    with pytest.raises(OverflowError) as problem:
        int(float("inf"))
    assert row[0] == str(problem.value)


def test_dictionary_equals_parsing_each_row(spark):
    texts = ["red", "RED ", "#fff", "hsl(200, 30%, 40%)", "rgb(inf, 1, 2)", "#ggg", "nope", "", None] + ["hsl(0, 0%, 7%)"] * 60
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, value string").repartition(4)
    once = {tuple(r) for r in colours.with_colour_code_once(rows, "value", "code").collect()}
    assert once == {tuple(r) for r in colours.with_colour_code(rows, "value", "code").collect()} and len(once) == len(texts)

import random

from pyspark.sql import functions as F

from huescope.functions.numeric import exact_mean, percent, round_half_even, upper_median


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [a / b * 100 for a in range(60) for b in range(1, 60)] + [rng.uniform(0, 21) for _ in range(3000)]
    values += [n / 200 for n in range(4200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", round_half_even(F.col("v"), 1).alias("one"), round_half_even(F.col("v"), 2).alias("two"))
    assert [r for r in rows.collect() if (r["one"], r["two"]) != (round(r["v"], 1), round(r["v"], 2))] == []


def test_upper_median_of_every_size(spark):
    rng = random.Random(3)
    groups = {n: [round(rng.uniform(1, 21), 2) for _ in range(n)] for n in range(1, 60)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "n int, v double")
    found = dict(df.groupBy("n").agg(upper_median("v")).collect())
    assert found == {n: sorted(vs)[n // 2] for n, vs in groups.items()}


def test_mean_and_percent(spark):
    df = spark.createDataFrame([(1.0,), (1.01,), (4.5,), (None,)], "v double")
    assert df.agg(exact_mean(F.col("v"), 2)).first()[0] == 6.51 / 3
    row = spark.range(1).select(percent(F.lit(13), F.lit(16)), percent(F.lit(0), F.lit(0))).first()
    assert tuple(row) == (81.2, None)

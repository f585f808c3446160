"""Scores, quickselect and ranks against plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from huescope.llm import target_resampling as resampling


def features(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, buckets=10_000, percent=25):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    source = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    wanted = Counter(bucket(f) for text in target for f in features(text)[1])
    S, T = sum(source.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        gains = [
            math.floor(1000 * math.log((wanted[b] + 1.0) * (S + buckets) / ((source[b] + 1.0) * (T + buckets)))) for b in map(bucket, found)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((len(words), doc_id, len(found), weight, weight + noise))
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = Counter()
    ranks = {}
    for n, row in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(row[1:], []).append(n)
    out = []
    for row in rows:
        left = ranks.get(row[1:], []) if row[0] >= 20 else []
        out.append((*row[1:], left[drawn[row]] if drawn[row] < len(left) else None))
        drawn[row] += 1
    return sorted(out, key=edge.key)


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


TARGET = ["tion of the re an", None, "", "The OF é ß tion in or", "漢字 漢字"]


def test_documents(spark, docs, no_docs):
    given = [(r[0], r[1]) for r in edge.rows()]
    found = resampling.resample(docs, benchmark(spark, TARGET))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=edge.key) == plain(given, TARGET)
    assert resampling.resample(no_docs, benchmark(spark, TARGET)).collect() == []


def test_repeated_rows_across_the_border(spark):
    """One row, two thirds of all: the draw ends among its copies."""
    text = "a b c d e f g h i j k l m n o p q r s t u"
    given = [(5, text)] * 80 + [(i, f"{text} {i}") for i in range(40)] + [(5, text + " v")] * 3
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    for target in ([], ["a b 7"]):
        for percent in (0, 25, 60, 100):
            found = resampling.resample(docs, benchmark(spark, target), percent=percent)
            assert sorted(map(tuple, found.collect()), key=edge.key) == plain(given, target, percent=percent)


def test_long_texts_in_segments(spark, monkeypatch):
    chance = random.Random(3)
    texts = ["".join(chance.choice("abAB  -é9") for _ in range(n)) for n in range(0, 900, 7)] + [" " * 300, "x" * 500]
    whole = [list(resampling.feature_hashes(t)) for t in texts]
    monkeypatch.setattr(resampling, "SEGMENT", 16)
    for text, expected in zip(texts, whole):
        pieces = list(resampling.feature_hashes(text))
        flat = [sum((p[i] for p in pieces), []) for i in (0, 1)]
        words, all_features = features(text)
        assert flat == [sum((p[i] for p in expected), []) for i in (0, 1)]
        assert flat[0] + flat[1] == [zlib.crc32(f.encode()) for f in all_features]


@pytest.mark.parametrize("pivots", [1, 5])
def test_quickselect_finds_every_key(spark, pivots):
    chance = random.Random(2)
    values = [chance.choice([3, 3, 3, chance.randrange(40)]) for _ in range(120)]
    frame = spark.createDataFrame([(v, None if v % 5 == 0 else v) for v in values], "a long, b long")
    keyed = frame.select(F.struct("a", "b").alias("key")).cache()
    order = sorted(values)
    for k in (1, 2, 40, 77, 119, 120):
        assert resampling.kth_key(keyed, k, pivots)["a"] == order[k - 1]
    assert resampling.kth_key(keyed, 121, pivots) is None


def test_gains_are_floors():
    source, target = np.array([0, 10, 3]), np.array([5, 0, 3])
    found = resampling.gains(source, target)
    want = [math.floor(1000 * math.log((t + 1) * 16 / ((s + 1) * 11))) for s, t in zip([0, 10, 3], [5, 0, 3])]
    assert found.tolist() == want

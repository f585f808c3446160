"""Clusters against plain integer arithmetic."""

import hashlib
import math
import random

import edge
import pytest

from huescope.llm import dimension_lloyd as lloyd

SCHEMA = "VEC_ID string, vec_id long, embedding array<float>, cluster int"


def rows(dimensions=5, count=300):
    chance = random.Random(4)
    centres = [[chance.gauss(0, 3) for _ in range(dimensions)] for _ in range(6)]
    data = []
    for i in range(count):
        x = [v + chance.gauss(0, 0.4) for v in centres[i % 6]]
        data.append((i, x))
    data += [(1000 + i, [0.5] * dimensions) for i in range(200)]  # one vector, a third of all rows
    data += [(0, data[0][1]), (0, [9.0] * dimensions), (None, [1.0] * dimensions), (None, None), (2000, None), (2001, [])]
    data += [(2002, [0.0] * (dimensions - 1)), (2003, [0.0] * (dimensions + 1)), (2004, [math.nan] + [0.0] * (dimensions - 1))]
    data += [(2005, [math.inf] + [0.0] * (dimensions - 1)), (2006, [None] + [0.0] * (dimensions - 1)), (2007, [-0.001] * dimensions)]
    data += [(2008, [1e30] * dimensions), (2009, [-math.inf] + [0.0] * (dimensions - 1))]
    return [("x", i, x, 7) for i, x in data]


def plain(data, clusters, rounds, dimensions):
    import numpy as np

    kept = []
    for _, vec_id, x, _ in data:
        if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x):
            scaled = [math.floor(256 * float(np.float32(v))) for v in x]
            if max(map(abs, scaled)) < lloyd.LARGEST:
                kept.append((vec_id, scaled))
    named = [k for k in kept if k[0] is not None]
    order = sorted(named, key=lambda k: (hashlib.sha256(f"2:{k[0]}".encode()).hexdigest(), k[1]))
    centroids = [list(x) for _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(x)[1] for _, x in kept]
        for n in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, owners) if o == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [(vec_id, *nearest(x)) for vec_id, x in kept]
    total = sum(d for _, d, _ in found)
    inertia = {n: sum(d for _, d, o in found if o == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(v, n, d, inertia[n], total, digest[n]) for v, d, n in found], key=edge.key)


@pytest.mark.parametrize(("clusters", "rounds", "width", "chunk"), [(7, 5, 2, 16), (40, 2, 5, 1000), (600, 1, 3, 50), (1, 0, 1, 7)])
def test_rounds_are_exact(spark, clusters, rounds, width, chunk):
    data = rows()
    given = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = lloyd.cluster_vectors(given, clusters, rounds, dimensions=5, width=width, rows=chunk)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=edge.key) == plain(data, clusters, rounds, 5)


def test_wide_differences_stay_exact(spark):
    data = [("", i, [x, -x, 0.001], 0) for i, x in enumerate([-500_000.0, 500_000.0, 0.0, 123_456.789, -0.004])]
    found = lloyd.cluster_vectors(spark.createDataFrame(data, SCHEMA), 2, 3, dimensions=3, width=2, rows=2)
    assert sorted(map(tuple, found.collect()), key=edge.key) == plain(data, 2, 3, 3)


def test_without_vectors_there_are_no_rows(spark):
    for data in ([], [("x", None, [1.0, 2.0], 1)], [("x", 1, None, 1)]):
        found = lloyd.cluster_vectors(spark.createDataFrame(data, SCHEMA), 3, 2, dimensions=2)
        assert found.collect() == [] and found.columns[0] == "vec_id"


def test_blocks_hold_columns_and_chunks_rows(spark):
    kept = lloyd.integer_vectors(spark.createDataFrame(rows(), SCHEMA), 5).repartition(3)
    blocks, ids = lloyd.store_blocks(kept, 5, 2, 16)
    sizes = blocks.selectExpr("chunk", "block", "length(x) as bytes").collect()
    lengths = {r["chunk"]: len(r["ids"]) for r in ids.collect()}
    assert max(lengths.values()) <= 16 and sum(lengths.values()) == kept.count()
    assert sorted((r["chunk"], r["block"], r["bytes"]) for r in sizes) == sorted(
        (c, b, 4 * n * w) for c, n in lengths.items() for b, w in ((0, 2), (1, 2), (2, 1))
    )

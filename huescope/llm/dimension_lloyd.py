"""Lloyd's clustering with the dimensions dealt to tasks.

Vectors are stored once in chunks of rows, and a chunk in blocks of columns; the
folder of a block holds its columns of all chunks. A round is three steps:

1. A column-block task holds only its slice of the centroids. It computes, for
   the rows of a chunk, the exact partial squared distances to every centroid:
   a matrix of rows by centroids.
2. The matrices of a chunk are added by chunk (a reduce by key) and the smallest
   sum of each row taken, the smaller number on ties. Groups are of fixed size,
   ``rows`` by centroids for each block, whatever the data.
3. Each block adds its columns over the rows of a cluster, folded by task and then
   by (block, cluster, column), and moves its own slice of the centroids to the
   floor of the mean. An empty cluster's centroid stays.

All arithmetic is on integers, so results are exact and do not depend on the
partitioning. The driver holds the centroids (clusters by dimensions numbers) and
nothing of the vectors. Each round's assignments are a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Columns of a block and rows of a chunk.
WIDTH, ROWS = 32, 1024
#: Components beyond this leave squared distances no room in a long.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, x array<int>: floor(scale * component) of the vectors that take part.

    Left out are null vectors, those with another number of components, with a
    null, infinite or undefined one, or one beyond ``LARGEST`` after scaling.
    """
    given = pick(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    scaled = given.where(F.size("e") == dimensions).select("vec_id", F.transform("e", lambda v: F.lit(float(scale)) * v).alias("e"))

    def usable(v):  # undefined numbers are greater than all others
        return v.isNotNull() & (v >= F.lit(float(-LARGEST))) & (v < F.lit(float(LARGEST)))

    return scaled.where(F.forall("e", usable)).select("vec_id", F.transform("e", lambda v: F.floor(v).cast("int")).alias("x"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, as rows; ties by the vector, null ids not.

    At most ``clusters`` rows reach the driver.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.where("vec_id is not null").orderBy(digest, "x").limit(clusters)
    return np.array([r["x"] for r in chosen.collect()], dtype=np.int64)


def store_blocks(kept: DataFrame, dimensions: int = DIMENSIONS, width: int = WIDTH, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Tables (chunk, block, x) and (chunk, ids): matrices of 32-bit numbers by column block, and their rows' ids."""
    kind = kept.schema["vec_id"].dataType.simpleString()
    blocks = range(-(-dimensions // width))

    def chunks(incoming: Iterator[tuple]) -> Iterator[tuple]:
        numbers = count(TaskContext.get().partitionId() << 32)
        ids, held = [], []

        def filled() -> Iterator[tuple]:
            chunk, matrix = next(numbers), np.array(held, dtype="<i4")
            for b in blocks:
                yield chunk, b, matrix[:, b * width : (b + 1) * width].tobytes(), None
            yield chunk, -1, None, ids

        for vec_id, x in incoming:
            ids.append(vec_id)
            held.append(x)
            if len(ids) == rows:
                yield from filled()
                ids, held = [], []
        if ids:
            yield from filled()

    made = arrow_map(kept.select("vec_id", "x"), chunks, f"chunk long, block int, x binary, ids array<{kind}>", 64)
    spark, path = kept.sparkSession, _written(made)
    table = spark.read.schema(made.schema).parquet(path)
    return table.where("block >= 0").select("chunk", "block", "x"), table.where("block = -1").select("chunk", "ids")


def _written(made: DataFrame) -> str:
    """Path of the rows, a folder for each block."""
    from huescope.sources.shared import fresh_path

    path = fresh_path(made.sparkSession, "column-blocks")
    made.write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def _partial_distances(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """chunk, part: each block's squared distances, rows by centroids, in the narrowest exact type."""
    slices = {b: centroids[:, b * width : (b + 1) * width] for b in range(-(-centroids.shape[1] // width))}

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, block, x in incoming:
            c = slices[block]
            matrix = np.frombuffer(x, "<i4").reshape(-1, c.shape[1]).astype(np.int64)
            part = np.zeros((len(matrix), len(c)), np.int64)
            for column in range(c.shape[1]):
                part += (matrix[:, column, None] - c[None, :, column]) ** 2
            narrow = len(part) == 0 or part.max() < 1 << 32
            yield chunk, narrow, part.astype("<u4" if narrow else "<i8").tobytes()

    return arrow_map(blocks.select("chunk", "block", "x"), rows, "chunk long, narrow boolean, part binary", 64)


def _assigned(parts: DataFrame, clusters: int) -> DataFrame:
    """chunk, cluster, distance: added over a chunk's blocks, the nearest centroid of each row."""

    def nearest(group: pa.Table) -> pa.Table:
        total = 0
        for narrow, part in zip(group.column("narrow").to_pylist(), group.column("part").to_pylist()):
            total = total + np.frombuffer(part, "<u4" if narrow else "<i8").reshape(-1, clusters).astype(np.int64)
        cluster = total.argmin(axis=1)
        distance = total[np.arange(len(total)), cluster]
        cells = [[group.column("chunk")[0].as_py()], [cluster.astype("<i4").tobytes()], [distance.astype("<i8").tobytes()]]
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=["chunk", "cluster", "distance"])

    return parts.groupBy("chunk").applyInArrow(nearest, "chunk long, cluster binary, distance binary")


def _moved(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after each block has moved its slice to the floors of the means."""
    clusters, dimensions = centroids.shape

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}
        sizes = np.zeros(clusters, np.int64)
        for block, x, cluster in incoming:
            owners = np.frombuffer(cluster, "<i4")
            matrix = np.frombuffer(x, "<i4").reshape(len(owners), -1).astype(np.int64)
            total = sums.setdefault(block, np.zeros((clusters, matrix.shape[1] + 1), np.int64))
            np.add.at(total, owners, np.append(matrix, np.ones((len(owners), 1), np.int64), axis=1))
        for block, total in sums.items():
            for number in np.flatnonzero(total[:, -1]).tolist():
                for column, value in enumerate(total[number, :-1].tolist()):
                    yield block, number, column, value, int(total[number, -1])

    joined = blocks.join(assigned.select("chunk", "cluster"), "chunk").select("block", "x", "cluster")
    folded = arrow_map(joined, rows, "block int, cluster int, place int, total long, n long", 20_000)
    sums = folded.groupBy("block", "cluster", "place").agg(F.sum("total").alias("s"), F.sum("n").alias("n"))
    mean = F.expr("(s - pmod(s, n)) div n")
    moved = centroids.copy()
    for r in sums.select("cluster", (F.col("block") * width + F.col("place")).alias("at"), mean.alias("mean")).collect():
        moved[r["cluster"], r["at"]] = r["mean"]  # clusters x dimensions numbers
    return moved


def _by_vector(spark: SparkSession, assigned: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """vec_id, cluster, distance from the matrices of the chunks."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for names, cluster, distance in incoming:
            yield from zip(names, np.frombuffer(cluster, "<i4").tolist(), np.frombuffer(distance, "<i8").tolist())

    joined = ids.join(assigned, "chunk").select("ids", "cluster", "distance")
    return arrow_map(joined, rows, f"vec_id {kind}, cluster int, distance long", 20_000)


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    width: int = WIDTH,
    rows: int = ROWS,
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that ``integer_vectors`` leaves out have no row. Repeated rows are
    clustered each and weigh each; a null id is kept but starts no centroid. With
    fewer vectors than clusters there are as many clusters as vectors with an id;
    with none, no rows. Inertias beyond a long are null. Further columns are ignored.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dimensions, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters, seed)
    final = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, {final.split(', ', 1)[1]}")
    blocks, ids = store_blocks(kept, dimensions, width, rows)
    for n in range(rounds + 1):
        assigned = stored(_assigned(_partial_distances(blocks, centroids, width), len(centroids)), "assignments")
        if n < rounds:
            centroids = _moved(blocks, assigned, centroids, width)
    found = stored(_by_vector(spark, assigned, ids, kind), "clustered")
    return found.join(F.broadcast(_described(found, centroids)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row per cluster: inertias and the digest of its centroid."""
    wide = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in wide.collect()}  # one row per cluster
    total, bound = sum(sums.values()), 1 << 63
    spark = found.sparkSession
    rows = [
        (c, s if s < bound else None, total if total < bound else None, ",".join(map(str, centroids[c].tolist())))
        for c, s in sums.items()
    ]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    return table.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))

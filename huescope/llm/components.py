"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import stored


def _nearest(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included."""
    both = links.union(links.select("v", "u"))
    return both.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u"), F.least("u", "least").alias("least")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the node's smallest neighbour."""
    both = links.union(links.select("v", "u"))
    joined = both.where("v > u").join(_nearest(links), "u")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, least: each linked node and the smallest node it reaches.

    ``links`` has two comparable columns, an edge in either direction. The rounds
    alternate until nothing moves; their number grows with the logarithm of the
    longest path. Minima fold on the map side, so a hub with many links sends few
    rows; each round is written to the shared folder, and only a count and a
    checksum come to the driver.
    """
    left, right = links.columns
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "star")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), "least").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
    )

"""Connected components of a graph given as edges, by alternating star contraction.

Every round hooks the neighbours of a node to the smallest one, once for larger and once for smaller neighbours; the number of edges does not
grow, and a few rounds (logarithmic in the size of the largest component) leave a star around the smallest node of each component. Both steps
are an aggregate with map-side combine and a join that Spark may split where a node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")).select("_a", F.least("_a", "_m").alias("_m"))
    least = settle(least)  # a table of its own, so that Spark may split the rows of a node with very many neighbours
    return both.join(least, F.col("a") == F.col("_a")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")))
    moved = down.join(least, F.col("a") == F.col("_a")).filter(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of the component and maps to itself.

    Loops and repeated edges are allowed, null ends are dropped.
    """
    edges = settle(edges.select("a", "b").dropna().filter(F.col("a") != F.col("b")).distinct())
    before = _print(edges)
    while True:
        edges = settle(_small(_large(edges)))
        now = _print(edges)
        if now == before:
            break
        before = now
    # Now every edge leads to a root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

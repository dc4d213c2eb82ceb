"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst longs): ``root`` is the smallest node of the component.

    Every node points at a smaller one of its component. In each round a node, and the node it points at, take the smallest target that a
    neighbour knows, and every pointer is doubled; a path of n nodes needs rounds in the order of log n. Each round is written once.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = settle(both.filter("src <> dst").distinct())
    point = settle(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("to")))
    total = None
    while True:
        now = point.agg(F.sum(F.col("to").cast("decimal(38,0)"))).first()[0]
        if now == total:  # pointers only ever become smaller
            return point.select("node", F.col("to").alias("root"))
        total = now
        far = point.alias("a").join(point.alias("b"), F.col("a.to") == F.col("b.node")).select(F.col("a.node"), F.col("a.to"), F.col("b.to").alias("far"))
        near = links.join(far.select(F.col("node").alias("dst"), "far"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("far").alias("least"))
        known = far.join(near, "node")
        ways = known.select("node", F.least("far", "least").alias("to")).unionByName(known.select(F.col("to").alias("node"), F.col("least").alias("to")))
        point = settle(ways.groupBy("node").agg(F.min("to").alias("to")))

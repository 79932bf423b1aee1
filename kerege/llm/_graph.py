"""Connected components of an edge table, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import dropped, written


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(row.n), int(row.h or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges stay the same: O(log n) rounds whatever
    the shape of the components. A node's partners are never gathered: minima are aggregated, then joined
    back, and Spark may split the many rows of one node. Edges with a null or to themselves are ignored.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _signature(now)
    while seen[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger partners move to the smallest of the neighbourhood
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        # small star: smaller partners and the node itself move to the smallest partner
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(now)
        dropped(large)
        now, before = after, seen
        seen = _signature(now)
        if seen == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

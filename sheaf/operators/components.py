"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import discard, written


def connected_components(edges: DataFrame, a: str = "src", b: str = "tgt", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, component being the smallest node reachable.

    Each round hangs the neighbours of every node on the smallest of them, first the larger neighbours (large star), then
    the smaller ones (small star), until nothing changes; the number of rounds grows with the logarithm of the component's
    size. Each step is a grouped minimum, which Spark combines before the shuffle, and a join with one row for each node,
    whose large partitions adaptive execution splits. Nodes are of any type that can be ordered. Loops and repeated edges are ignored,
    as are edges with a null end. An error is raised if max_rounds don't do.
    """
    e = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct())
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(root.select("hi", "m")).where("hi <> lo").distinct()
        last, e = e, written(small)
        discard(last)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(e.select("lo", "lo").distinct())

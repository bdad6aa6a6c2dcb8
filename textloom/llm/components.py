"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, skew_join


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long), root being the least node of its component.

    Alternates large-star and small-star steps, each a shuffle of the edges alone, until nothing changes;
    the number of rounds grows with the logarithm of the largest component. Each round is stored, so
    there is no lineage over rounds. Groups hold one edge a node, so a hub is a long list, not a product, and is
    spread over tasks where it is joined."""
    now = ws.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the least of it and its neighbours
        least = ws.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = skew_join(both, least.drop("n"), ["a"], ws, counts=least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours go to the least of them
        lower = large.where("a > b").distinct()
        lowest = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = ws.table(small.where("a > b").distinct(), "star")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(now, least)
        now = after
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ws.table(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")

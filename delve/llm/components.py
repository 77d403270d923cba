"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delve.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's (larger or smaller) neighbours, linked to the least node of its neighbourhood instead."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        moved = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        to = edges.join(least, "a")
        moved = to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(to.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long): a row (node, root) for each node that is not its component's least.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path, and no round holds more edges than
    the input.  No edges: no rows.
    """
    held = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = materialise(held, "edges")
    seen = None
    while True:
        held = materialise(_stars(_stars(held, large=True), large=False), "edges")
        state = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state

"""Connected components of a graph stored as an edge table, by alternating star contractions.

Nodes are longs; edges need not be unique. A round links every node's larger neighbours
to the smallest one (large star), then its smaller neighbours (small star). Minima are
taken in partial aggregates, and the joins are plain equi-joins, which adaptive
execution splits where one node has most edges. Nothing is collected but one checksum a
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b. Both stars link the chosen neighbours of a node to the smallest node around it."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = around.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge; the component is its smallest node."""
    x, y = F.col(a), F.col(b)
    state = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    state, seen = staged(state, "edges"), None
    while True:
        digest = state.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)).alias("h")).first()
        if digest == seen:
            break
        seen = digest
        state = staged(_star(_star(state, large=True), large=False), "edges")
    # A star by now: every node points at its smallest.
    hubs = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs.withColumn("component", F.col("node")))

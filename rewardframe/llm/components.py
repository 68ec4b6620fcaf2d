"""Connected components by alternating large-star and small-star steps on DataFrames.

Links are never collected: each step is one grouped minimum (partially aggregated, so a hub with
very many links is summed up before the shuffle) and one join, and each round is written to the
shared folder. The number of rounds grows with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: a, b with a > b (signed longs). Each node's neighbours (large:
    those above it; small: itself and those below it) are linked to the node's least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # a node's neighbours above it
        out = edges.join(least, edges["b"] == least["n"]).select(F.col("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        out = edges.join(least, edges["a"] == least["n"])
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (longs, any order, repeats allowed). Returns node, root for every node that
    is not its component's least node; an empty table gives no rows."""
    edges = written(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        last, edges = edges, written(_star(_star(edges, large=True), large=False))
        discard(last)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Blocks of vectors: how a stated set of queries meets all rows, block by block.

Rows are numbered and written, dealt to blocks of about ``BLOCK`` vectors by a hash of their number (so
rows that share an id, or are equal, are spread, too), and every query is copied to every block; so the
copied side is the smaller one. A block's rows and its queries come to one task sorted, the rows first:
the task indexes the block once and searches it for a few queries at a time. It holds one block and
``QUERIES`` queries; no side is broadcast, collected or cross-joined. A query's own row is left out by
its number; other rows with its id are candidates like any other.

A search that can use a bound meets the square root of all blocks first; the k-th best score that a query
has found there goes with it to the other blocks, where nothing below it matters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardframe.llm.common import written

BLOCK = 4096
QUERIES = 512

#: What a search gives: places of the queries asked, ids, scores.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row (a number of its own), id, vector (doubles) of the rows that have an id and a vector without
    null, NaN or infinite components."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.filter(F.col(id_col).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled up with 0."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _met(batches: Iterator[pa.RecordBatch], width: int, index: Callable, search: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the block's own rows (asked false) before its queries, by number."""
    block: int | None = None
    ready: Any = None
    own: tuple[list[int], list[int], list[np.ndarray]] = ([], [], [])
    asked: tuple[list[int], list[int], list[np.ndarray], list[float]] = ([], [], [], [])

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal ready, asked
        if asked[0] and own[0]:
            if ready is None:
                ready = index(np.array(own[1], dtype=np.int64), _matrix(own[2], width))
            rows, wanted = np.array(own[0], dtype=np.int64), np.array(asked[0], dtype=np.int64)
            at = np.minimum(np.searchsorted(rows, wanted), len(rows) - 1)
            bounds = np.array([-math.inf if b is None else b for b in asked[3]])
            places, ids, scores = search(ready, np.where(rows[at] == wanted, at, -1), _matrix(asked[2], width), bounds)
            found = (wanted[places], np.array(asked[1], dtype=np.int64)[places], ids, scores)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "query_id", "vec_id", "score"])
        asked = ([], [], [], [])

    for batch in batches:
        vector = batch.column("vector")
        flat, at = np.asarray(vector.flatten()), np.concatenate(([0], np.cumsum(np.asarray(vector.value_lengths())))).tolist()
        columns = (batch.column(c).to_pylist() for c in ("block", "asked", "row", "id", "bound"))
        for i, (b, is_query, row, x, bound) in enumerate(zip(*columns)):
            if b != block:
                yield from answers()
                block, ready, own = b, None, ([], [], [])
            if is_query and len(asked[0]) == QUERIES:
                yield from answers()
            for kept, value in zip(asked if is_query else own, (row, x, flat[at[i] : at[i + 1]].copy(), bound)):
                kept.append(value)
    yield from answers()


def best_of_all(
    vectors: DataFrame,
    query: F.Column,
    index: Callable[[np.ndarray, np.ndarray], Any],
    search: Callable[[Any, np.ndarray, np.ndarray, np.ndarray], Found],
    k: int,
    score: str,
    block: int = BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """For each row of ``vectors`` (row, id, vector; written) that ``query`` holds for, the k best of what
    ``search(index(ids, matrix), places of the queries' own rows or -1, query matrix, bounds)`` finds in
    all blocks: query_id, rank, vec_id, score; highest first, ties to the smaller id. ``bounded``: whether
    the search uses bounds (-inf where there is none)."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    blocks, width = max(1, math.ceil(size["n"] / block)), size["width"] or 0
    of = F.pmod(F.xxhash64("row"), F.lit(blocks))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")

    def met(first: int, last: int, asked: DataFrame) -> DataFrame:
        """What the queries find in some of the blocks."""
        rows = vectors.select(of.alias("block"), F.lit(False).alias("asked"), "row", "id", "vector", F.lit(None).cast("double").alias("bound"))
        every = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))).alias("block")
        copies = asked.select(every, F.lit(True).alias("asked"), "row", "id", "vector", "bound")
        # as many partitions as it takes to keep blocks apart: comparing them is the work
        both = rows.filter((F.col("block") >= first) & (F.col("block") < last)).unionByName(copies)
        dealt = both.repartition(min(4 * (last - first), 8192), "block")
        found = dealt.sortWithinPartitions("block", "asked", "row").mapInArrow(
            lambda it: _met(it, width, index, search), f"query long, query_id long, vec_id long, score {score}"
        )
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    asked = vectors.filter(query).withColumn("bound", F.lit(None).cast("double"))
    head = math.ceil(math.sqrt(blocks))
    if not bounded or head == blocks:
        return met(0, blocks, asked).select("query_id", "rank", "vec_id", "score")
    first = written(met(0, head, asked))
    bounds = first.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("bound"))
    rest = met(head, blocks, asked.drop("bound").join(bounds, "row", "left"))
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]

"""Approximate nearest neighbours by inner product: collision-counting hashing.

Inner products become distances by one more component: with M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (M q / |q|, 0); then the nearest row has the largest
inner product. ``PROJECTIONS`` seeded Gaussian directions are the hash functions: each block keeps,
for each direction, its rows sorted by their projection. A query opens a window around its own
projection in every direction and widens all of them by virtual rehashing (radius R, then GROWTH R,
and so on); a row's collisions are the windows that hold it. Rows with at least ``THRESHOLD`` of all
directions are verified with the exact inner product on the original vectors. A block is done when k
verified rows are within R, or all rows are verified. The square root of all blocks is searched that way
first; in the others a query opens its windows at once at the distance of the k-th row that it has
found, and is done: nothing farther is among its k nearest. So the more blocks there are, the smaller
is the share of rows that are verified.

Every row is indexed, and nothing is capped: the windows widen until the block is done. At R a row
at distance R collides in 68 % of the directions on average.

Defined results: null or zero vectors and those that hold null or non-finite components take no
part, nor do rows without an id; rows that share an id count each, as queries and as candidates, and a
query leaves out its own row only; an empty table gives an empty result; with k rows or fewer all are
found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import written
from rewardframe.llm.vectors import Found, best_of_all, select_best, sound

K = 20
QUERY_EVERY = 20
PROJECTIONS = 64
THRESHOLD = 0.6
FIRST_RADIUS, GROWTH = 0.8, 1.2
#: Rings that add fewer collisions than this for each row are counted row by row.
SPARSE = 4
SEED = 77
BLOCK = 8192


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(PROJECTIONS, size)).T


@dataclass(frozen=True)
class Index:
    """A block's rows, and for each direction their order, their projections in that order, and
    each row's place in it."""

    ids: np.ndarray
    rows: np.ndarray
    order: np.ndarray
    line: np.ndarray
    rank: np.ndarray


def indexed(largest: float, size: int):
    def index(ids: np.ndarray, rows: np.ndarray) -> Index:
        n = len(ids)
        rest = np.sqrt(np.maximum(0.0, largest**2 - (rows**2).sum(axis=1)))
        seen = (np.column_stack((rows, rest)) @ directions(size + 1)).T
        order = np.argsort(seen, axis=1, kind="stable")
        rank = np.empty((PROJECTIONS, n), dtype=np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(rank, order, np.arange(n, dtype=rank.dtype)[None, :], axis=1)
        return Index(ids, rows, order, np.take_along_axis(seen, order, axis=1).astype(np.float32), rank)

    return index


def search(k: int, largest: float, size: int):
    def run(block: Index, own: np.ndarray, given: np.ndarray, bounds: np.ndarray) -> Found:
        ids, rows, order, line, rank = block.ids, block.rows, block.order, block.line, block.rank
        n, needed = len(ids), math.ceil(THRESHOLD * PROJECTIONS)
        norms = np.sqrt((given**2).sum(axis=1))
        centres = (largest * given / norms[:, None]) @ directions(size + 1)[:size]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def edges(open_: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low = [np.searchsorted(x, c, "left") for x, c in zip(line, (centres[open_] - radius[open_, None]).T.astype(np.float32))]
            high = [np.searchsorted(x, c, "right") for x, c in zip(line, (centres[open_] + radius[open_, None]).T.astype(np.float32))]
            return np.array(low).T, np.array(high).T

        counts = np.zeros((len(given), n), dtype=np.uint8)
        verified: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(given)
        open_ = np.arange(len(given))
        final = np.isfinite(bounds)
        reach = np.sqrt(np.maximum(0.0, 2 * largest**2 - 2 * largest * np.where(final, bounds, 0.0) / norms))
        radius = np.where(final, reach, FIRST_RADIUS * largest)
        low = high = edges(open_, np.zeros(len(given)))[0]  # empty windows at first
        while len(open_):
            new_low, new_high = edges(open_, radius)
            added = (new_high - new_low - high + low).sum(axis=1)
            left = []
            for at, q in enumerate(open_.tolist()):
                before = counts[q] >= needed
                if added[at] < SPARSE * n:  # narrow rings: count the rows that they add
                    rings = [
                        piece
                        for o, a, b, c, d in zip(order, new_low[at], low[at], high[at], new_high[at])
                        for piece in (o[a:b], o[c:d])
                    ]
                    counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.uint8)
                else:  # wide windows: compare every row's place in order with the window
                    inside = rank - new_low[at].astype(rank.dtype)[:, None] < (new_high - new_low)[at].astype(rank.dtype)[:, None]
                    counts[q] = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                new = np.flatnonzero((counts[q] >= needed) & ~before)
                rows_seen, scores = verified[q]
                rows_seen = np.concatenate((rows_seen, new))
                scores = np.concatenate((scores, rows[new] @ given[q]))
                verified[q] = rows_seen, scores
                # |x' - q'|^2 = 2 M^2 - 2 M <x, q> / |q|
                near = 2 * largest**2 - 2 * largest * scores / norms[q] <= radius[q] ** 2
                if not final[q] and near.sum() - (rows_seen[near] == own[q]).sum() < k and len(rows_seen) < n:
                    left.append(at)
            open_, low, high = open_[left], new_low[left], new_high[left]
            radius *= GROWTH
        for q, row in enumerate(own.tolist()):
            rows_seen, scores = verified[q]
            other = rows_seen != row
            found, scores = ids[rows_seen[other]], scores[other]
            best = select_best(scores, found, k)
            out.append((np.full(len(best), q), found[best], scores[best]))
        return tuple(np.concatenate([x[j] for x in out]) for j in range(3))

    return run


def nearest(vectors: DataFrame, query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): about the k rows of the largest inner product for
    each row that ``query`` (a condition on ``id``) holds for, itself left out."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    rows = written(sound(vectors, id_col, vector_col).filter(square > 0))
    found = rows.agg(F.sqrt(F.max(square)), F.max(F.size("vector"))).first()
    largest, size = found[0] or 1.0, found[1] or 1
    return best_of_all(rows, query, indexed(largest, size), search(k, largest, size), k, "double", BLOCK, bounded=True)


def op10_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("id") % QUERY_EVERY == 0)

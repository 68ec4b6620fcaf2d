"""Exact top-k search: exhaustive term-at-a-time accumulation over inverted lists.

A vector is a bag of terms (its positions) with whole weights floor(256 * x). Each block holds its
inverted lists: for each term the rows whose weight is not 0, and the weights. A block of queries
walks the terms: each query that has the term scatters its weight times the list into its dense
array of scores. The best of the array are taken by partition selection, and the blocks' best are
merged.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; rows that share an id count each, as queries and as candidates, and a query leaves
out its own row only; vectors of different lengths meet on the positions that both have; an empty vector
scores 0. Vectors whose products could pass 64 bits fail the job by name, as a wrapped score would be a
wrong result. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import written
from rewardframe.llm.vectors import Found, best_of_all, select_best, sound

K = 5
SCALE = 256
QUERY_EVERY = 50

def weights_of(matrix: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * matrix), -(2.0**62), 2.0**62).astype(np.int64)


@dataclass(frozen=True)
class Inverted:
    """A block's inverted lists: ids of its rows, where each term's list starts, rows and weights."""

    ids: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray


def inverted(ids: np.ndarray, matrix: np.ndarray) -> Inverted:
    weights = weights_of(matrix)
    term, row = np.nonzero(weights.T)
    return Inverted(ids, np.searchsorted(term, np.arange(weights.shape[1] + 1)), row, weights[row, term])


def search(k: int):
    def run(block: Inverted, own: np.ndarray, queries: np.ndarray, _: np.ndarray) -> Found:
        ids, starts, rows, weights = block.ids, block.starts, block.rows, block.weights
        wanted = weights_of(queries)
        if float(np.abs(wanted).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, wanted.shape[1]) >= 2.0**63:
            raise ValueError("components are too large: inner products of their weights pass 64 bits")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(own), 32):  # a few queries at a time: their scores stay in cache
            part = wanted[i : i + 32]
            scores = np.zeros((len(part), len(ids)), dtype=np.int64)
            for term in range(min(part.shape[1], len(starts) - 1)):
                listed, posted = rows[starts[term] : starts[term + 1]], weights[starts[term] : starts[term + 1]]
                whole = len(listed) == len(ids)
                for q in np.flatnonzero(part[:, term]):
                    if whole:
                        scores[q] += part[q, term] * posted
                    else:
                        scores[q, listed] += part[q, term] * posted
            for q, row in enumerate(own[i : i + 32].tolist()):
                best = select_best(scores[q], ids, k + 1)
                best = best[best != row][:k]
                out.append((np.full(len(best), i + q), ids[best], scores[q, best]))
        return tuple(np.concatenate([x[j] for x in out]) for j in range(3))

    return run


def top_k(vectors: DataFrame, query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the k rows with the highest inner product of whole
    weights for each row that ``query`` (a condition on ``id``) holds for, itself left out."""
    return best_of_all(written(sound(vectors, id_col, vector_col)), query, inverted, search(k), k, "long")


def op2_top_k(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("id") % QUERY_EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.r <> c.r
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

"""Exact and approximate vector search against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from rewardframe.llm import ann, topk, vectors
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, weigh):
    """Each sound row against all others, with the number of times that each answer comes."""
    kept = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, w) in enumerate(kept):
        if q % every == 0:
            scores = [(-sum(weigh(a) * weigh(b) for a, b in zip(w, v)), i) for other, (i, v) in enumerate(kept) if other != at]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]))
    return out


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(0, 700, 10)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (50, rows[5][1]), (12, rows[9][1]), (12, rows[9][1]), (100, None), (150, [None, 1.0]), (200, [float("nan"), 0.0])]
    rows += [(None, [1.0, 2.0]), (3, []), (4, [0.5]), (5, [0.0] * 6), (7, [float("inf")]), (100000, rows[5][1]), (8, rows[5][1] + [1.0])]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors.best_of_all, "__defaults__", (block, False))
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op2_top_k(df).collect())
    assert got == brute(rows, 50, 5, lambda x: math.floor(256 * x))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.op2_top_k(none).count() == 0
    assert ann.op10_nearest(none).count() == 0


@pytest.mark.parametrize("sparse", [0, 10**6])
def test_both_ways_of_counting_agree(monkeypatch, sparse):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(300, 12))
    ids = np.arange(300)
    largest = float(np.sqrt((matrix**2).sum(axis=1).max()))
    block = ann.indexed(largest, 12)(ids, matrix)
    own = np.where(np.arange(0, 300, 9) % 2 == 0, np.arange(0, 300, 9), -1)
    bounds = np.where(np.arange(len(own)) % 3 == 0, 0.5, -np.inf)
    want = ann.search(7, largest, 12)(block, own, matrix[::9], bounds)
    monkeypatch.setattr(ann, "SPARSE", sparse)
    got = ann.search(7, largest, 12)(block, own, matrix[::9], bounds)
    assert all((a == b).all() for a, b in zip(got, want))


@pytest.mark.parametrize("block", [8192, 100])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    df = read(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], dtype=np.float64)
    got = ann.op10_nearest(df).collect()
    assert len(got) == 20 * sum(i % 20 == 0 for i in ids)
    at = {i: n for n, i in enumerate(ids.tolist())}
    hits = 0
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        scores = matrix @ matrix[at[q]]
        assert all(abs(r.score - scores[at[r.vec_id]]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        scores[at[q]] = -np.inf
        hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits / len(got) >= 0.9


def test_few_rows_are_all_found(spark):
    rows = [(0, [3.0, 4.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [-1.0, 0.5], 1), (4, [3.0, 4.0], 1), (None, [1.0, 1.0], 1), (5, None, 2)]
    got = ann.op10_nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 4, 25.0), (2, 1, 3.0), (3, 3, -1.0)]


def test_rows_with_one_id_answer_each(spark):
    """Queries and candidates that share an id, some of them equal: all are kept."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (7, [0.25, 0.0]), (7, [0.25, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in ann.op10_nearest(df).collect())
    assert got == brute(rows, 20, 20, lambda x: x)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op2_top_k(df).collect()) == brute(rows, 50, 5, lambda x: math.floor(256 * x))


def test_products_beyond_64_bits_are_named(spark):
    df = spark.createDataFrame([(0, [2.0**50], 1), (1, [2.0**50], 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        topk.op2_top_k(df).collect()


def test_bounds_lower_the_share_of_verified_rows():
    """A block searched with the score of the k-th best row of a larger and larger table: fewer of its rows
    are verified, and at least 0.9 of those above the bound are found."""
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(48000, 64))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    queries, own = matrix[:40], np.arange(40)
    scores = queries @ matrix.T
    np.put_along_axis(scores, own[:, None], -np.inf, axis=1)
    block = ann.indexed(1.0, 64)(np.arange(6000), matrix[:6000])
    shares = []
    for n in (6000, 24000, 48000):
        bounds = np.partition(scores[:, :n], n - 20, axis=1)[:, n - 20]
        places, ids, _ = ann.search(6000, 1.0, 64)(block, own, queries, bounds)  # all that is verified
        found = set(zip(places.tolist(), ids.tolist()))
        wanted = set(zip(*(x.tolist() for x in np.nonzero(scores[:, :6000] >= bounds[:, None]))))
        assert len(wanted & found) >= 0.9 * len(wanted)
        shares.append(len(found) / (40 * 6000))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3

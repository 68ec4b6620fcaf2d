"""Mixing against a plain water-filling, and the quotas it must meet."""

import re
from collections import defaultdict

import pytest

from rewardframe.llm import mixing
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, epochs=3.0):
    """Clamp and share again until no source is above its cap."""
    total, clamped = float(sum(sizes.values())), set()
    while True:
        free = {s for s in sizes if s not in clamped and weights[s] > 0 and sizes[s] > 0}
        rest = total - sum(epochs * sizes[s] for s in clamped)
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else share.get(s, 0.0) for s in sizes}
        clamped |= over


def check(rows, docs, weights):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += size_of(r.text)
    targets = plain_targets(dict(sizes), weights)
    taken, largest = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * (1 + targets[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6, s


def test_documents(spark):
    docs = read(spark, SF, "documents")
    rows = mixing.op4_mixing(docs).collect()
    given = docs.collect()
    order = sorted({r.source for r in given}, key=lambda s: s.encode())
    check(rows, given, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    again = mixing.op4_mixing(docs.repartition(9)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_are_clamped(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    rows = [(i, "w " * (1 + i % 7), "abcd"[min(3, i % 40)], "clash") for i in range(600)]
    rows += [(1000, None, None, "x"), (1001, "one two", None, "x"), (1002, "", "empty", "x"), (1003, None, "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string")
    given = docs.collect()
    order = ["a", "b", "c", "d", "empty", None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    check(mixing.op4_mixing(docs).collect(), given, weights)
    mixed = mixing.mix_sources(docs, mixing.cycled_weights(docs))
    out = mixing.repeated(docs, mixing.cycled_weights(docs))
    assert out.columns == docs.columns and {r.mix_size for r in out.collect()} == {"clash", "x"}
    want = {r.doc_id: r.mix_copies for r in mixed.collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert max(want.values()) == 3


def test_one_repeated_row(spark):
    docs = spark.createDataFrame([(7, "a b c", "s")] * 50, "doc_id long, text string, source string")
    rows = mixing.op4_mixing(docs).collect()
    assert {(r.source_size, r.target, r.taken) for r in rows} == {(150, 150.0, 3)}


@pytest.mark.parametrize("text", [None, ""])
def test_nothing_to_mix(spark, text):
    schema = "doc_id long, text string, source string"
    assert mixing.op4_mixing(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.op4_mixing(spark.createDataFrame([(1, text, None), (None, text, "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2

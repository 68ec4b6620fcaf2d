"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from rewardframe.llm import simhash
from rewardframe.llm.components import connected_components


def test_golay_patterns_cover_the_space():
    errors = simhash._error_patterns()
    assert errors.shape == (2048, 6)
    upper, lower = simhash._syndromes()
    words = np.arange(1 << 15, dtype=np.int64) * 251 % (1 << 23)
    code = words ^ errors[upper[words >> 11] ^ lower[words & 2047], 0]
    assert not (upper[code >> 11] ^ lower[code & 2047]).any()
    assert np.bitwise_count(words ^ code).max() == 3


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(5)
    a, b = [], []
    for _ in range(4000):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 4])):
            y ^= 1 << bit
        a.append(x)
        b.append(y)
    ka = simhash.bucket_keys(np.array(a, dtype=np.uint64))
    kb = simhash.bucket_keys(np.array(b, dtype=np.uint64))
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def corpus():
    rng = random.Random(11)
    texts = [None, "", "   ", "one", "One", "a b c", "É b c d", "x " * 30000]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("bucket", [2048, 3])
def test_matches_brute_force(spark, bucket):
    texts = corpus()
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows_of = simhash.near_duplicates(docs, bucket=bucket).collect()
    got = {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in rows_of}
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (doc, _), root in zip(rows, roots):
        least[root] = min(least.get(root, doc), doc)
    assert got == {doc: (f"{f:016x}", least[root]) for (doc, _), f, root in zip(rows, fps, roots)}


def test_crowded_buckets_are_linked_through_midpoints(spark):
    """A large group around one fingerprint, all pairs of it in crowded buckets."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            x ^= 1 << bit
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    rows = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    df = spark.createDataFrame(rows, "fp long").repartition(4)
    links = simhash.fingerprint_links(df, bucket=4)
    linked = {frozenset((r.a % 2**64, r.b % 2**64)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in map(tuple, linked))
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(links).collect()}
    want = plain_components(fps)
    got = [roots.get(f, f) for f in fps]
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_null_ids_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, fp string"
    docs = spark.createDataFrame(
        [(None, "a b c d e", "x"), (4, "a b c d e", "y"), (4, "a b c d e", "y"), (None, "only me here now", "z"), (9, "q r s t", None)],
        schema,
    )
    got = sorted(simhash.op8_near_duplicates(docs).collect(), key=str)
    assert len(got) == 5
    kept = sorted(simhash.first_of_each(docs).collect(), key=str)
    assert sorted((r.doc_id or 0, r.text, r.fp or "") for r in kept) == [(0, "only me here now", "z"), (4, "a b c d e", "y"), (9, "q r s t", "")]
    none = spark.createDataFrame([], schema)
    assert simhash.op8_near_duplicates(none).count() == 0
    assert simhash.first_of_each(none).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 6), (n + 6, n + 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges.repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, n + 6: n + 5}

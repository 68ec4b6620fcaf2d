"""Vector codes against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from rewardframe.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, code int"


def brute(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w, books = width // 4, []
    codes, errors = [""] * len(kept), [0] * len(kept)
    for p in range(4):
        parts = [v[p * w : (p + 1) * w] for _, v, _ in kept]
        book = [list(x) for x in parts[:256]]
        for step in range(5):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in parts]
            if step == 4:
                break
            for k in range(len(book)):
                own = [x for x, (_, e) in zip(parts, near) if e == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
        books.append(book)
        codes = [c + f"{e:02x}" for c, (_, e) in zip(codes, near)]
        errors = [x + d for x, (d, _) in zip(errors, near)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors)), key=repr)


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def odd_rows(n=420, spread=1.0):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 10))
    rows = [(int(i), (centres[i % 9] + spread * rng.normal(size=10)).tolist(), int(i % 4) if i % 5 else None) for i in rng.permutation(n) * 3]
    rows += [(6, rows[0][1], 1), (6, rows[0][1], 1), (6, rows[1][1], 2), (None, rows[2][1], None), (3, None, 1), (4, [None, 1.0], 1)]
    return rows + [(5, [float("nan")] * 10, 1), (7, [math.inf] * 10, 1), (8, [0.5], 3), (9, [], 3), (10, [-0.0001] * 10, 3)]


@pytest.mark.parametrize("n, spread, block", [(420, 1.0, 4096), (420, 0.02, 64), (60, 1.0, 7)])
def test_codes_equal_plain_rounds(spark, n, spread, block):
    rows = odd_rows(n, spread)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    coded, books = vc.codes(df, block=block)
    want = brute(rows)
    assert sorted(((r.id, r.code, r.error) for r in coded.collect()), key=repr) == sorted(((r[0], r[1], r[2]) for r in want), key=repr)
    assert vc.codebook_digest(books) == want[0][4]
    if block == 4096:
        assert rows_of(vc.op12_codes(df)) == want


def test_codes_decode_to_entries(spark):
    rows = odd_rows(50)
    coded, books = vc.codes(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    for r in vc.decoded(coded, books).collect():
        entries = [books[k][int(r.code[2 * k : 2 * k + 2], 16)] for k in range(4)]
        assert r.vector == [x / 1024 for e in entries for x in e.tolist()]


def test_empty_and_wide_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vc.op12_codes(none).count() == 0
    assert vc.op12_codes(spark.createDataFrame([(1, [], 1, "", 1, 1)], SCHEMA)).collect()[0].code == "00000000"
    # beyond 2^53 the products are whole-number ones
    rows = [(i, [float(i % 7) * 2**15, float(i) * 2**14, 3.0, -float(i)], None) for i in range(40)]
    assert rows_of(vc.op12_codes(spark.createDataFrame([(*r, "", 1, 1) for r in rows], SCHEMA))) == brute(rows)
    with pytest.raises(ValueError, match="too large"):
        vc.op12_codes(spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0], 1, "", 1, 1)], SCHEMA))


@pytest.mark.parametrize("kind", ["spread", "clustered", "repeated"])
def test_cover_tree(kind):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 400
    points = {
        "spread": rng.normal(size=(700, 8)) * 300,
        "clustered": centres[rng.integers(0, 40, 700)] + rng.normal(size=(700, 8)) * 4,
        "repeated": centres[rng.integers(0, 3, 700)],
    }[kind]
    points = np.floor(points).astype(np.int64)
    tree = vc.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(700))
    own = points[tree.order].astype(float)
    for n in range(len(tree.point)):
        a, b = tree.start[n], tree.end[n]
        assert np.linalg.norm(own[a:b] - own[tree.point[n]], axis=1).max() <= tree.radius[n] + 1e-9
        children = range(tree.child[n], tree.child_end[n])
        if children:
            assert [tree.start[c] for c in children] == [a, *(tree.end[c] for c in children)][:-1] and tree.end[children[-1]] == b
            stand = own[tree.point[list(children)]]
            gaps = np.linalg.norm(stand[:, None] - stand[None], axis=2)[~np.eye(len(stand), dtype=bool)]
            assert not len(gaps) or gaps.min() > max(tree.radius[c] for c in children) - 1e-9
    entries = np.concatenate((points[:200], points[:56]))  # every one of the last 56 is a tie
    got, compared = vc.assign(tree, points[tree.order], entries)
    assert (got == vc.squared_distances(points[tree.order], entries).argmin(axis=1)).all()
    counts, sums = vc.entry_sums(tree, np.concatenate((np.zeros((1, 8), dtype=np.int64), np.cumsum(points[tree.order], axis=0))), points[tree.order], entries)
    assert counts.sum() == 700 and (sums.sum(axis=0) == points.sum(axis=0)).all()
    if kind == "clustered":
        assert compared < 700 * 256 / 4

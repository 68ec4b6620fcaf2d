"""Quality classifier: held-out accuracy, and its scores against a plain discriminant."""

import numpy as np
import pytest

from rewardframe.llm import quality
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = quality.op9_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_scores_equal_a_plain_discriminant():
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(60, d)), rng.normal(1, 2, size=(90, d))]
    cov = [np.cov(a.T) for a in x]
    pooled = sum((len(a) - 1) * c for a, c in zip(x, cov)) / (150 - 1)
    model = quality.Discriminant(0.6)
    model.means, model.factors, logs = [a.mean(0) for a in x], [], []
    for c in cov:
        s = (1 - quality.POOL) * c + quality.POOL * pooled
        low = np.linalg.cholesky(s)
        model.factors.append(np.linalg.inv(low))
        logs.append(np.linalg.slogdet(s)[1] / 2)
    model.offset = np.log(90 / 60) + logs[0] - logs[1]
    points = rng.normal(size=(20, d))

    def density(p, k):
        s = (1 - quality.POOL) * cov[k] + quality.POOL * pooled
        e = p - x[k].mean(0)
        return -e @ np.linalg.solve(s, e) / 2 - np.linalg.slogdet(s)[1] / 2

    want = [1 / (1 + np.exp(density(p, 0) + np.log(60) - density(p, 1) - np.log(90))) for p in points]
    assert np.allclose(model.score(points), want)


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(8)
    names = [f"q_{f}" for f in quality.FEATURES]
    rows = [(int(k), *map(float, rng.normal(k, 1 + k, len(names)))) for k in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "quality int, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    model = quality.fit(df, pool=0.0, ridge=0.0)
    for k in (0, 1):
        x = np.array([r[1:] for r in rows if r[0] == k])
        assert np.allclose(model.means[k], x.mean(0))
        assert np.allclose(np.linalg.inv(model.factors[k].T @ model.factors[k]), np.cov(x.T))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.1), (None, "some text here.", 0.2), (3, "x" * 200000, 0.3), (3, "x" * 200000, 0.3)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality.op9_quality(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.accepted(docs, labels).count() == 5
    none = docs.limit(0)
    assert quality.op9_quality(none, labels.limit(0)).count() == 0


@pytest.mark.parametrize("text", [None, b"", b" \n ", b"!!! !!!", "é à".encode()])
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text)).all()

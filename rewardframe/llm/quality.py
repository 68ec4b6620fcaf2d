"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (``FEATURES``). For each class the mean and the
covariance are learned from all labelled training rows by sums that Spark aggregates; the class
covariance is shrunk towards the pooled one (``POOL``) and then towards a multiple of the identity
(``RIDGE``). The score is the posterior of label 1: the difference of the two log densities, each
a Mahalanobis distance by the inverse of the class's cached Cholesky factor, plus the log prior.

Defined results: a null text counts as empty and is scored like any other; an id whose label rows
disagree, a null label and a null id train nothing; without training rows of both classes every
score is the share of label 1 among those rows (0.5 without any); tables may be empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import fold, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
POOL, RIDGE = 0.3, 0.02
FEATURES = (
    "words", "word_length", "distinct", "neighbour_repeats", "stop_words", "upper", "digits", "marks",
    "plain_words", "line_repeats", "line_words", "closed_lines",
)
# Frequent function words of English, French, German and Spanish.
STOP = frozenset(
    w.encode()
    for w in (
        "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their "
        "they this to was were which with you "
        "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que "
        "qui sa se ses son sur un une vous "
        "als am auch auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nach nicht oder "
        "sich sie sind so über um und von vor war wie wir zu zum "
        "al como con del el ella ellos era es esta fue ha la las lo los más me muy o para pero por se sin su sus una y"
    ).split()
)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _classes() -> np.ndarray:
    """For each byte value a row of a 0/1 matrix: upper, digit, mark, letter (with all bytes of
    other characters)."""
    out = np.zeros((256, 4))
    for b in range(33, 256):
        c = chr(b)
        kind = 3 if b > 126 or c.islower() else 0 if c.isupper() else 1 if c.isdigit() else 2
        out[b, kind] = 1
    return out


CLASSES = _classes()


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text given as UTF-8, in the order of FEATURES."""
    text = text or b""
    words = text.translate(LOWER).split()
    n = len(words)
    upper, digits, marks, letters = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ CLASSES
    seen = upper + digits + marks + letters

    def share(part: float, whole: float, usual: float, weight: float) -> float:
        # shares of short texts lean towards the usual one
        return math.sqrt((part + usual * weight) / (whole + weight))

    lines = [line for line in text.split(b"\n") if line.strip()]
    k = max(1, len(lines))
    m = max(1, n)
    plain = sum(map(bytes.isalnum, words))
    return [
        math.log1p(n),
        math.log1p((seen + 20) / (n + 4)),
        math.log((len(set(words)) + 1) / (n + 1)),
        math.sqrt(sum(map(eq, words, words[1:])) / m),
        share(sum(map(STOP.__contains__, words)), n, 0.2, 8),
        share(upper, seen, 0.03, 60),
        share(digits, seen, 0.0, 60),
        share(marks, seen, 0.03, 60),
        share(plain, n, 0.85, 8),
        math.sqrt(1 - len(set(lines)) / k) if lines else 0.0,
        math.log1p(n / k),
        math.sqrt(sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / k),
    ]


def _with_statistics(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        table = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(x)) for x in table.T],
            names=[*keep, *(f"q_{f}" for f in FEATURES)],
        )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a column q_... for each statistic."""
    narrow = docs.select("doc_id", "text")
    kind = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"q_{f} double" for f in FEATURES)
    return narrow.mapInArrow(lambda it: _with_statistics(it, ["doc_id"]), schema)


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of label 0 and 1, and what is added to the difference
    of their squared distances; ``prior`` alone where a class has too few rows."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None
    offset: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None or self.factors is None:
            return np.full(len(x), self.prior)
        bad, good = (((x - m) @ f.T) ** 2 @ np.ones(x.shape[1]) for m, f in zip(self.means, self.factors))
        return 1 / (1 + np.exp(-np.clip(self.offset + (bad - good) / 2, -700, 700)))


def fit(labelled: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """``labelled``: quality (0 or 1) and the statistics. Two rows of sums reach the driver."""
    names = [f"q_{f}" for f in FEATURES]
    d = len(names)
    sums = [F.sum(c) for c in names]
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(d) for j in range(i, d)]
    rows = {r[0]: r[1:] for r in labelled.groupBy("quality").agg(F.count(F.lit(1)), *sums, *products).collect()}
    n = [rows[k][0] if k in rows else 0 for k in (0, 1)]
    prior = n[1] / sum(n) if sum(n) else 0.5
    if min(n) < 2:
        return Discriminant(prior)
    means, scatters = [], []
    for k in (0, 1):
        mean = np.array(rows[k][1 : d + 1]) / n[k]
        scatter = np.zeros((d, d))
        scatter[np.triu_indices(d)] = rows[k][d + 1 :]
        scatter = scatter + np.triu(scatter, 1).T - n[k] * np.outer(mean, mean)
        means.append(mean)
        scatters.append(scatter)
    pooled = (scatters[0] + scatters[1]) / (sum(n) - 1)
    factors, logs = [], []
    for k in (0, 1):
        cov = (1 - pool) * scatters[k] / (n[k] - 1) + pool * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(np.diag(low)).sum())
    return Discriminant(prior, means, factors, math.log(n[1] / n[0]) + logs[0] - logs[1])


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the rows of ``stats`` outside the held-out fold that have a label."""
    agreed = (
        labels.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .select("doc_id", "quality")
    )
    return fit(stats.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).join(agreed, "doc_id"))


def scored(stats: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    names = [f"q_{f}" for f in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(c)) for c in names]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(model.score(x))], names=[*keep, "score"]
            )

    kinds = dict(stats.dtypes)
    return stats.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``."""
    model = train(with_statistics(docs), labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        texts = text.cast(pa.binary()).to_pylist()
        return pa.array(model.score(np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = written(with_statistics(docs))
    out = scored(stats, train(stats, labels), ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

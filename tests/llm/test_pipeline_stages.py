"""The corpus pipeline against a plain version of its stages."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rewardframe.llm import mixing, pieces, quality
from rewardframe.llm.common import read, written
from tests.llm.test_mixing import plain_targets, size_of
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_accepted(docs, labels):
    x = {r.doc_id: np.array(quality.statistics((r.text or "").encode())) for r in docs}
    train = [(x[i], q) for i, q in labels.items() if i in x and zlib.crc32(str(i).encode()) % 5]
    groups = [np.array([v for v, q in train if q == k]) for k in (0, 1)]
    pooled = sum((len(g) - 1) * np.cov(g.T) for g in groups) / (len(train) - 1)
    means, covs = [g.mean(0) for g in groups], []
    for g in groups:
        cov = (1 - quality.POOL) * np.cov(g.T) + quality.POOL * pooled
        covs.append((1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / len(cov) * np.eye(len(cov)))

    def log_density(v, k):
        e = v - means[k]
        return np.log(len(groups[k])) - e @ np.linalg.solve(covs[k], e) / 2 - np.linalg.slogdet(covs[k])[1] / 2

    return [r for r in docs if 1 / (1 + np.exp(np.clip(log_density(x[r.doc_id], 0) - log_density(x[r.doc_id], 1), -700, 700))) >= 0.3]


def test_stages_equal_plain_versions(spark):
    docs = read(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    good = written(corpus_pipeline.keep_good(spark, docs, SF))
    assert good.columns == docs.columns
    want = plain_accepted(docs.collect(), labels)
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in want)
    assert 0 < len(want) < docs.count()

    unique = written(corpus_pipeline.drop_near_copies(spark, good, SF))
    assert unique.columns == docs.columns
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text) for r in rows])
    kept = {}
    for r, root in zip(rows, roots):
        kept.setdefault(root, r)
    assert sorted(unique.collect()) == sorted(kept.values())
    assert len(kept) < len(rows)

    mixed = written(corpus_pipeline.mix(spark, unique, SF))
    assert mixed.columns == docs.columns
    sizes, by_source = defaultdict(int), defaultdict(list)
    drawn = unique.select("doc_id", "source", "text", mixing.draw(F.col("doc_id"), F.col("text")).alias("draw")).collect()
    for r in drawn:
        sizes[r.source] += size_of(r.text)
        by_source[r.source].append((r.draw, r.doc_id, size_of(r.text)))
    order = sorted(sizes, key=lambda s: s.encode())
    targets = plain_targets(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    copies = Counter()
    for s, rows in by_source.items():
        whole, quota, upto = int(targets[s] // sizes[s]), targets[s] % sizes[s], 0
        for _, doc, size in sorted(rows):
            upto += size
            copies[doc] += whole + (upto - size / 2 <= quota)
    assert Counter(r.doc_id for r in mixed.collect()) == +copies

    out = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert all(r.round_trip for r in out)
    assert Counter(r.doc_id for r in out if r["sample"] == 1) == +copies
    assert all(1 <= r["sample"] <= pieces.SAMPLES for r in out)

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r["sample"], r.ids) for r in whole) == sorted((r.doc_id, r["sample"], r.ids) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]


def odd_documents(spark):
    """Null and empty texts, repeated rows, and columns of any type and of the operators' own names."""
    rows = [
        (r.doc_id, r.text, r.lang, r.source, r.n_chars, {1: "m"}, "id", "note", 7, [1], (1, "x")) for r in read(spark, SF, "documents").collect()
    ]
    m, tail = {2: "n"}, ("id2", "note2", 8, [2], (2, "y"))
    rows += [(900, None, "en", None, 0, m, *tail), (901, "", None, "s", 0, None, *tail), (None, "one two three", "en", "s", 3, m, *tail)]
    rows += [rows[3], rows[3], (rows[5][0], *rows[5][1:5], m, *tail)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, tags map<int,string>, _kept_id string, mix_note string, "
        "mix_size int, `a.b` array<int>, row struct<n:int,s:string>"
    )
    return spark.createDataFrame(rows, schema)


def test_stages_keep_columns_of_any_type_and_name(spark):
    docs = written(odd_documents(spark))
    good = written(corpus_pipeline.keep_good(spark, docs, SF))
    unique = written(corpus_pipeline.drop_near_copies(spark, good, SF))
    mixed = written(corpus_pipeline.mix(spark, unique, SF))
    for before, after in ((docs, good), (good, unique), (unique, mixed)):
        assert after.dtypes == docs.dtypes
        texts = [Counter(map(str, df.collect())) for df in (before, after)]
        assert set(texts[1]) <= set(texts[0]) and texts[1]
    assert {r.mix_note for r in mixed.collect()} >= {"note"} and all(r.tags is None or r.tags for r in mixed.collect())
    ids = Counter(r.doc_id for r in unique.collect())
    assert max(ids.values()) == 1
    assert corpus_pipeline.encode(spark, mixed, SF).count() == 2 * mixed.count()


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_near_copies, corpus_pipeline.mix):
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == 0

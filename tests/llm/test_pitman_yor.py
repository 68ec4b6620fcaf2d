"""Language model: counts and base scores by brute force, probabilities that add up, perplexity."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rewardframe.llm import pitman_yor, restaurants
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*(text or "").encode().translate(pitman_yor.LOWER).split(), b" "]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def check_base(rows, docs):
    counts = Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, x in docs:
        ts = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want[i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6) + 0.0] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in rows)
    assert got == want


@pytest.mark.parametrize("block_tokens", [pitman_yor.BLOCK_TOKENS, 20000])
def test_documents(spark, block_tokens):
    docs = read(spark, SF, "documents")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    rule = pitman_yor.fold(docs["doc_id"], 5) == 1
    rows = pitman_yor.score_texts(docs, rule, block_tokens).collect()
    check_base(rows, given)
    mine = sum(r.score for r in rows if r.held_out)
    base = sum(r.base_score for r in rows if r.held_out)
    assert base < mine < 0


def test_held_out_perplexity_is_lower_than_the_base(spark):
    rows = [r for r in pitman_yor.op5_score(read(spark, SF, "documents")).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    mine, base = (10 ** (-sum(r[c] for r in rows) / n) for c in ("score", "base_score"))
    assert mine < 0.8 * base


def stirling(c):
    """Weights of the ways to seat n customers at t tables, from one customer after the other."""
    s = {(1, 1): 1.0}
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1, t] = s.get((n, t - 1), 0.0) + (n - 0.5 * t) * s.get((n, t), 0.0)
    return [s[c, t] for t in range(1, c + 1)]


def conditional(c, others, own, total, strength, discount, parent):
    weights = []
    for t, w in enumerate(stirling(c), 1):
        for j in range(t):
            w *= strength + 0.5 * (others + j)
            w *= (own + j - discount if own + j else 1.0) / (parent + total + j)
        weights.append(w)
    return np.array(weights) / sum(weights)


@pytest.mark.parametrize("given", [(2, 3, 1, 100, 1.0, 0.8, 1.0), (7, 50, 30, 200, 0.5, 0.6, 1.0), (33, 500, 300, 2000, 1.0, 0.7, 1.0), (60, 2, 0, 50, 1.0, 0.7, 1.0), (90, 300, 900, 3000, 1.0, 0.7, 1.0)])
def test_tables_are_drawn_from_their_conditional(given):
    n = 60000
    c, others, own, total, *rest = given
    draws = (np.random.default_rng(3).permutation(n) + 0.5) / n
    t = restaurants.table_draws(*(np.full(n, x) for x in (c, others, own, total)), draws, *rest)
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / n, conditional(*given), atol=2 / n)


def test_strength_follows_the_seating():
    """The posterior of the strength, given restaurants seated with it, is around it."""
    rng = np.random.default_rng(8)
    for true in (0.3, 3.0):
        customers, tables = np.full(400, 60), []
        for _ in customers:
            t = 1
            for n in range(1, 60):
                t += rng.random() < (true + 0.5 * t) / (true + n)
            tables.append(t)
        got, strength = [], 1.0
        for step in range(60):
            logs, ones = restaurants.strength_sums(customers, np.array(tables), strength, rng)
            strength = rng.gamma(1.0 + ones, 1.0 / (1.0 - logs))
            got.append(strength)
        assert abs(np.mean(got[10:]) / true - 1) < 0.3


class Plain:
    """The sampler with a dictionary of dishes, one dish after the other."""

    def __init__(self, docs):
        learned = [tokens(x) for x, h in docs if not h]
        self.words = Counter(t for x in learned for t in x)
        every = {t for x, _ in docs for t in tokens(x)} | {pitman_yor.BEGIN}
        ids = {t: i for i, t in enumerate(sorted(every, key=xxhash.xxh64_intdigest))}
        self.pairs = Counter(p for x in learned for p in zip([pitman_yor.BEGIN, *x], x))
        self.customers = Counter()
        for (u, _), n in self.pairs.items():
            self.customers[u] += n
        once, twice = (sum(n == k for n in self.words.values()) for k in (1, 2))
        self.discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        tables, strength = dict.fromkeys(self.pairs, 1), pitman_yor.STRENGTH
        self.kept = []
        for sweep in range(pitman_yor.SWEEPS):
            before = dict(tables)
            t_u, c_w, total = self.sums(before)
            for (u, w), n in self.pairs.items():
                if n > 1:
                    old = before[u, w]
                    p = conditional(n, t_u[u] - old, c_w[w] - old, total - old, strength, self.discount, pitman_yor.STRENGTH)
                    draw = pitman_yor.pair_draws(np.array([ids[u]]), np.array([ids[w]]), sweep)[0]
                    tables[u, w] = 1 + int((np.cumsum(p) < draw).sum())
            t_u, c_w, total = self.sums(tables)
            if sweep >= pitman_yor.BURN:
                self.kept.append((dict(tables), t_u, c_w, total, strength))
            customers, seated = np.zeros((2, pitman_yor.RANGE), dtype=np.int64)  # one range holds all words here
            for u, n in self.customers.items():
                customers[ids[u]], seated[ids[u]] = n, t_u[u]
            rng = np.random.default_rng([pitman_yor.SEED, sweep + 1, 0])
            logs, ones = restaurants.strength_sums(customers, seated, strength, rng)
            strength = float(np.random.default_rng([pitman_yor.SEED, sweep]).gamma(1.0 + ones, 1.0 / (1.0 - logs)))

    def sums(self, tables):
        t_u, c_w = Counter(), Counter()
        for (u, w), t in tables.items():
            t_u[u] += t
            c_w[w] += t
        return t_u, c_w, sum(c_w.values())

    def chance(self, u, w):
        """Of a known word, or of the unknown one (None), after a word."""
        out = 0.0
        for tables, t_u, c_w, total, s in self.kept:
            new = (pitman_yor.STRENGTH + self.discount * len(self.words)) / (pitman_yor.STRENGTH + total)
            parent = new if w is None else (c_w[w] - self.discount) / (pitman_yor.STRENGTH + total)
            own = self.pairs[u, w] - 0.5 * tables.get((u, w), 0)
            out += (own + (s + 0.5 * t_u[u]) * parent) / (s + self.customers[u])
        return out / len(self.kept)

    def score(self, text):
        ts = [t if t in self.words else None for t in tokens(text)]
        return sum(math.log10(self.chance(u, w)) for u, w in zip([pitman_yor.BEGIN, *ts], ts))


def small_corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    texts = [" ".join(rng.choice(words, rng.integers(0, 25), p=weights / weights.sum())) for _ in range(160)]
    return [(x, i % 4 == 0) for i, x in enumerate(texts)] + [("w1 new W2 other", True), ("the the " * 40, False)]


@pytest.mark.parametrize("sizes", [(pitman_yor.BLOCK_TOKENS, pitman_yor.BUCKET_TOKENS), (300, 90)])
def test_scores_equal_the_plain_sampler(spark, sizes):
    docs = small_corpus()
    df = spark.createDataFrame([(i, x, h) for i, (x, h) in enumerate(docs)], "doc_id long, text string, held boolean").repartition(3)
    plain = Plain(docs)
    assert max(plain.pairs.values()) > restaurants.WHOLE and any(t > 1 for t in plain.kept[0][0].values())
    for r in pitman_yor.score_texts(df, df["held"], *sizes).collect():
        assert r.score == pytest.approx(plain.score(docs[r.doc_id][0]), abs=1e-9)
    # what stands after each known word, after the begin and after an unknown word adds up
    for u in [*plain.words, pitman_yor.BEGIN, None]:
        assert sum(plain.chance(u, w) for w in [*plain.words, None]) == pytest.approx(1, abs=1e-12)


def test_all_texts_add_up(spark):
    """Probabilities of all texts of up to six words, known ones and the unknown one, through the scores."""
    rng = np.random.default_rng(5)
    learned = ["", "a", "a b", "b", "a a", "b a", "a", "b c", "c"] * 3 + [" ".join(rng.choice(list("abc"), 2)) for _ in range(12)]
    asked = [" ".join(x) for n in range(7) for x in itertools.product([*"abc", "zz"], repeat=n)]
    rows = [(i, x, i >= len(learned)) for i, x in enumerate(learned + asked)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(df, df["held"]).collect()}
    by_length = [sum(10 ** got[i] for i, x, h in rows if h and len(x.split()) == n) for n in range(7)]
    # the texts not counted go on as those of five and six words do
    rest = by_length[6] * (by_length[6] / by_length[5]) / (1 - by_length[6] / by_length[5])
    assert sum(by_length) < 1 and sum(by_length) + rest == pytest.approx(1, abs=1e-4)


def test_odd_rows(spark):
    docs = [(1, "A b"), (2, None), (3, ""), (4, "b c d"), (None, "a A"), (5, "zz"), (5, "zz"), (6, "b " * 50000)]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, block int, held string")
    check_base(pitman_yor.op5_score(df).collect(), docs)
    assert pitman_yor.op5_score(df.limit(0)).count() == 0
    nothing = pitman_yor.score_texts(df, df["block"] == 1).collect()
    assert {(r.train_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in nothing} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("sizes", [(pitman_yor.BLOCK_TOKENS, pitman_yor.BUCKET_TOKENS, 50), (300, 90, 7)])
def test_pieces_leave_the_scores(spark, sizes):
    """Blocks that handle a few tokens' pairs at a time, buckets cut and not."""
    docs = small_corpus()
    df = spark.createDataFrame([(i, x, h) for i, (x, h) in enumerate(docs)], "doc_id long, text string, held boolean").repartition(3)
    plain = Plain(docs)
    rows = pitman_yor.score_texts(df, df["held"], *sizes).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.score == pytest.approx(plain.score(docs[r.doc_id][0]), abs=1e-9)


def by_address(batches, address, *kinds):
    """What Spark sends on: rows for an address, sorted by place and kind, their texts' ids too."""
    table = pa.concat_tables([pa.Table.from_batches([b]) for b in batches], promote_options="default")
    rows = [r for r in table.to_pylist() if r["address"] == address and r["kind"] in kinds]
    return pa.Table.from_pylist(sorted(rows, key=lambda r: (r["to"], r["kind"])), table.schema).to_batches()


def test_a_block_holds_little_beside_its_texts():
    """Bytes for each token of a block, while it sends its pairs and while it scores them; with all pairs
    at once it took 103 and 141."""
    rng = np.random.default_rng(11)
    size, docs, buckets, near = 1000, 600, 8, 22
    texts = [" ".join(f"w{x}" for x in (rng.random(size - 1) ** 3 * 30000).astype(int)) for _ in range(docs)]
    given = pa.RecordBatch.from_pydict({"doc_id": range(docs), "text": texts, "held": [i % 5 == 1 for i in range(docs)]})
    piece = size * docs // 8

    def peak(run):
        tracemalloc.start()
        out = list(run())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / (size * docs)

    P = pitman_yor
    numbered = list(P._numbered(iter([given]), 2 * size * docs, 1))
    dictionary = by_address(numbered, P.HASHES, P.DICTIONARY)
    merged = list(P._merged(iter(dictionary)))
    stats = by_address(merged, P.HASHES, P.STATS)
    offsets, n = {}, 0
    for r in sorted((r for b in stats for r in b.to_pylist()), key=lambda r: r["to"]):
        offsets[r["to"]], n = n, n + r["origin"]
    placed = list(P._placed(iter(by_address([*dictionary, *merged], P.HASHES, P.DICTIONARY, P.VOCABULARY)), offsets))
    blocks = by_address([*numbered, *placed], P.BLOCK, P.TEXTS, P.LOCALS, P.IDS)
    paired, most = peak(lambda: P._paired(iter(blocks), buckets, near, piece))
    assert most < 75
    replies, model = P.Letters(), P.Model(size * docs, n, 0.5)
    model.customers, model.strengths = [1e6] * 3, [1.0] * 3
    for r in (r for b in paired for r in b.to_pylist()):
        if r["kind"] == P.PAIRS:
            times = P._unpacked(r["c"], r["m"])
            replies.add(P.BLOCK, r["origin"], P.ANSWERS, r["to"] * P.MOST_HASHES + r["seq"], times, np.minimum(times, 1).repeat(3, axis=0))
        else:
            ids = P._unpacked(r["a"], r["m"])
            replies.add(P.BLOCK, r["origin"], P.STATES, r["to"] * P.MOST_HASHES + r["seq"], ids, np.ones((P.TOTALS + 6, r["m"]), dtype=np.int64))
    given = by_address([*blocks, *replies.rest()], P.BLOCK, P.TEXTS, P.LOCALS, P.IDS, P.STATES, P.ANSWERS)
    scored, most = peak(lambda: P._scored(iter(given), model, buckets, near, piece))
    assert most < 75
    assert sum(b.num_rows for b in scored) == docs

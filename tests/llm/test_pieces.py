"""Sampled segmentations against enumerated ones, and exact round trips."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from rewardframe.llm import pieces
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.001"
VOCABULARY = pieces.load()
LATTICES = pieces.Lattices(VOCABULARY)
DECODE = pieces.Decoder(VOCABULARY)
NUMBER = {p: i for i, p in enumerate(VOCABULARY.pieces) if VOCABULARY.normal[i]}


def segmentations(word):
    """All segmentations of a word of known characters, with their log probabilities."""
    out = []

    def extend(at, ids, score):
        if at == len(word):
            out.append((tuple(ids), score))
        for end in range(at + 1, min(len(word), at + 16) + 1):
            i = NUMBER.get(word[at:end])
            if i is not None:
                extend(end, [*ids, i], score + LATTICES.scores[i])

    extend(0, [], 0.0)
    total = math.log(sum(math.exp(s) for _, s in out))
    return {ids: s - total for ids, s in out}


def samples_of(texts, seeds, k):
    samples, kappa = pieces.sample_texts(LATTICES, texts, np.asarray(seeds).astype(np.uint64), k)
    out = [[] for _ in texts]
    for s in samples:
        ids, counts = pieces.piece_ids(LATTICES, s)
        ends = np.cumsum(counts)
        for row, a, b, lp, g in zip(s.rows, ends - counts, ends, s.log_prob, s.gumbel):
            out[row].append((tuple(ids[a:b].tolist()), lp, g))
    return out, kappa


def test_short_texts_have_all_their_segmentations():
    for text in ("a", "to", "the", "can't", "of it"):
        want = segmentations("▁" + text.replace(" ", "▁"))
        (got,), (kappa,) = samples_of([text], [9], len(want) + 3)
        assert {ids: round(lp, 9) for ids, lp, _ in got} == {ids: round(lp, 9) for ids, lp in want.items()}
        assert kappa == -np.inf
        gumbels = [g for _, _, g in got]
        assert gumbels == sorted(gumbels, reverse=True)


def test_frequencies_without_replacement():
    n = 40000
    want = {ids: math.exp(lp) for ids, lp in segmentations("▁of▁it").items()}
    got, kappa = samples_of(["of it"] * n, np.arange(n) * 7919, 2)
    firsts, pairs = Counter(g[0][0] for g in got), Counter((g[0][0], g[1][0]) for g in got)
    for a, p in want.items():
        assert abs(firsts[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
        for b, q in want.items():
            both = p * q / (1 - p) if a != b else 0.0
            assert abs(pairs[a, b] / n - both) < 5 * math.sqrt(both * (1 - both) / n) + 1e-9
    # inclusion scores are unbiased weights: the sum of p / score over a sample is 1 on average
    scores = [sum(math.exp(lp) / -math.expm1(-math.exp(lp - k)) for _, lp, _ in g) for g, k in zip(got, kappa)]
    assert abs(np.mean(scores) - 1) < 5 * np.std(scores) / math.sqrt(n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the \n\t▁é漢😀\U0010fffe\x00Zx"), max_size=120), max_size=6))
def test_round_trips(texts):
    got, _ = samples_of(texts, range(len(texts)), 3)
    for text, mine in zip(texts, got):
        assert all(DECODE(list(ids)) == text for ids, _, _ in mine)
        assert len({ids for ids, _, _ in mine}) == len(mine) >= 1


def test_decoding_equals_the_library():
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ("Hello  world", "é 漢 😀 x", " lead", "tail ", "a\nb"):
        (mine,), _ = samples_of([text], [3], 3)
        for ids, _, _ in mine:
            assert library.decode(list(ids)) == DECODE(list(ids)) == text
        assert DECODE(library.encode(text)) == text


def test_documents_anywhere(spark):
    docs = read(spark, SF, "documents")
    got = {(r.doc_id, r.sample): r for r in pieces.op6_encode(docs).collect()}
    again = {(r.doc_id, r.sample): r.ids for r in pieces.op6_encode(docs.repartition(7)).collect()}
    assert {k: r.ids for k, r in got.items()} == again
    assert all(r.round_trip and 0 <= r.inclusion <= 1 and r.log_prob <= 1e-9 for r in got.values())
    assert {k[0] for k in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    decoded = pieces.decode(pieces.op6_encode(docs).select("doc_id", "ids")).collect()
    assert all(r.text == texts[r.doc_id] for r in decoded)


def test_odd_rows(spark):
    rows = [(1, None, [1]), (2, "", [2]), (None, "null id", [3]), (4, "x" * 100000, [4]), (4, "x" * 100000, [4]), (5, "word " * 60000, [5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = pieces.op6_encode(df).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, r.sample) for r in got) == Counter(
        {(1, 1): 1, (2, 1): 1, (None, 1): 1, (None, 2): 1, (4, 1): 2, (4, 2): 2, (5, 1): 1, (5, 2): 1}
    )
    assert [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    assert pieces.op6_encode(df.limit(0)).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>")).collect()[0].text is None


@pytest.mark.parametrize("kept", [0, 6_000_000])
def test_small_caches_change_nothing(monkeypatch, kept):
    monkeypatch.setattr(pieces, "KEPT_EDGES", kept)
    texts = ["the quick brown fox", "jumps over", "the quick brown fox"]
    first, _ = samples_of(texts, [1, 2, 1], 2)
    second, _ = samples_of(texts, [1, 2, 1], 2)
    assert first == second and first[0] == first[2]


def log_mass(text):
    """Log of the sum over all segmentations of a text of known characters, forwards."""
    text = "▁" + text.replace(" ", "▁")
    sums = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        found = [sums[a] + LATTICES.scores[NUMBER[text[a:end]]] for a in range(max(0, end - 16), end) if text[a:end] in NUMBER]
        sums[end] = np.logaddexp.reduce(found)
    return sums[-1]


@pytest.mark.parametrize(
    "text", ["see https://example.com/a/very/long/path/to/some/page?with=query&and=more now", "=" * 700, "a" + " " * 150 + "b", "abc=" * 2000]
)
def test_long_words_are_whole(text):
    mass = log_mass(text)
    got, _ = samples_of([text] * 40, range(40), 2)
    for mine in got:
        for ids, lp, _ in mine:
            assert lp == pytest.approx(sum(LATTICES.scores[i] for i in ids) - mass, abs=1e-6)
            assert DECODE(list(ids)) == text
    # draws differ along a word
    assert len({ids for mine in got for ids, _, _ in mine}) > 40


def test_carriage_returns_are_in_pieces():
    for text in (");\r", "}\r", "a \r", "\r\r", "x,\r"):
        want = segmentations("▁" + text.replace(" ", "▁"))
        (got,), _ = samples_of([text], [9], len(want) + 3)
        assert {ids: round(lp, 9) for ids, lp, _ in got} == {ids: round(lp, 9) for ids, lp in want.items()}
        assert any(len(VOCABULARY.pieces[i]) > 1 and "\r" in VOCABULARY.pieces[i] for ids in want for i in ids)
    (got,), _ = samples_of(["a();\r\n\tb\r\n"], [4], 5)
    assert all(DECODE(list(ids)) == "a();\r\n\tb\r\n" for ids, _, _ in got)


def test_characters_that_stand_alone_follow_from_the_vocabulary():
    n = len(VOCABULARY.pieces)
    more = pieces.Vocabulary([*VOCABULARY.pieces, "\n", "\n\n", "▁\n"], np.append(VOCABULARY.normal, [True] * 3), VOCABULARY.first_byte)
    lattices, decode = pieces.Lattices(more), pieces.Decoder(more)
    text = "a\n\nb \nc\n"
    samples, _ = pieces.sample_texts(lattices, [text], np.array([1], dtype=np.uint64), 40)
    ids = [pieces.piece_ids(lattices, s)[0].tolist() for s in samples if len(s.rows)]
    assert all(decode(x) == text for x in ids) and {n + 1, n + 2} <= {i for x in ids for i in x}

"""Spelling variants against comparing all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from rewardframe.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, lo int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_texts():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abÀé", k=rng.randint(7, 9))) for _ in range(60)]
    stems += [w[:i] + "b" + w[i:] for w in stems[:5] for i in (1, 3)] + [w + "bb" for w in stems[:3]]
    stems += ["prefixprefix" + "".join(rng.choices("ab", k=5)) for _ in range(20)] + ["".join(rng.choices("ab", k=5)) + "commonending" for _ in range(20)]
    rows = []
    for i in range(400):
        words = [rng.choice(rng.choice([stems[:5], stems[:5], stems[:5], stems])) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", ", ", "7", "×÷-"]).join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in words)))
    return rows + [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (900, None), (901, ""), (902, "éÉ " * 9), (904, "chainbase " * 160 + "chainbasex " * 30 + "chainbasexy " * 6), (903, ("x" * 3000 + " ") * 5 + ("x" * 1500 + "y" + "x" * 1499 + " ") * 30)]


@pytest.mark.parametrize("group_chars", [spelling.GROUP_CHARS, 40])
def test_variants_equal_brute_force(spark, group_chars):
    rows = some_texts()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    want = brute_variants(brute_words(rows))
    assert sum(x[1] is not None for x in want) > 5 and any(x[2] != x[1] and x[1] for x in want)  # a chain of forms too
    assert rows_of(spelling.variants(df, group_chars=group_chars)) == want


@pytest.mark.parametrize("group_chars", [spelling.GROUP_CHARS, 60, 1])
def test_all_near_pairs_once(spark, group_chars):
    """Every short word over two letters, so that all kinds of runs and ties come up."""
    words = [f"{i:b}".translate({48: 97, 49: 98})[1:] for i in range(2, 256)] + ["à" * 7, "à" * 8, "àà" + "z" * 5 + "àà", "àà" + "z" * 4 + "àà"]
    df = spark.createDataFrame([(w, 5 + i % 7) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.n_near, r.near_n, r.near) for r in spelling.near_words(df, group_chars).collect()}
    n = {w: 5 + i % 7 for i, w in enumerate(words)}
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        # one letter at least is copied
        near = [v for v in near if min(len(v), len(w)) >= 1]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_states_are_minimal():
    a = spelling.Acceptor()
    words = sorted(["walking", "talking", "walked", "talked", "walk", "talk"])
    start = a.initial(words)
    assert sorted(a.shared(start, start)) == words
    assert len({(f, *sorted(x.items())) for f, x in zip(a.final, a.arcs)}) == len(a.arcs)
    # w and t lead to one state
    assert a.arcs[start]["w"] == a.arcs[start]["t"]
    assert len(a.arcs) == 9


def test_empty_tables(spark):
    assert spelling.op11_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "a", 1, 1), (2, "", "a", 1, 1), (3, "12 .", "b", 1, 1)], SCHEMA)
    assert spelling.op11_variants(none).count() == 0


def test_small_room(spark):
    rows = some_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.vocabulary(df, room=3).collect()}
    assert got == brute_words(rows)

"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit
transducer and the acceptor again.

* Words are maximal runs of letters, ASCII-lowered; a seeded rule (a checksum of the row's id and the
  run) deletes a letter of about every 199th run. A word has LEAST_LENGTH letters and occurs
  LEAST_COUNT times.
* Acceptor: the minimised acyclic automaton of the words (equal right languages are one state).
* One-edit transducer: state 0 copies letters; one replaced or inserted letter leads to state 1, which
  copies the rest. It edits at the first letter in which two words differ, so each pair has one path.
  The acceptor is deterministic, so states of the composition are (p, 0, p) before the edit and
  (p, 1, q) after it; from the latter, the accepted rests are the words that p and q share.

Plan: the vocabulary does not fit one task, so the composition is cut by its initial states. Two words
of which the shorter one has m letters agree on the first or on the last m // 2 letters, whichever
side the edit is not on. So each word comes under both halves, once as the shorter and once as the
longer word; a group (same m, same half) is one initial state: the acceptor's state after those
letters. Groups of over GROUP_CHARS letters are cut in the same way again, by halves of what is still
open between the agreed letters, until they are small or at most one letter is open; so no common
prefix or suffix makes a group that does not fit a task. A pair that agrees on both halves is accepted
where its first half agrees only (``lim``).

Near words are counted per task, then summed; forms are followed by joins of the table of forms with
itself, which double the way at each round (a form is at least RATIO times as frequent as its word, so
chains are short). Nothing but counts reaches the driver.

Defined results: null and empty texts have no words; a null id counts as an empty one in the rule; rows
with the same id and text count each; a text's length is not bounded; an empty table gives no rows; other
columns are not read. Of near words with equal counts the least in code-point order counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import LOWER, written
from rewardframe.session import spread

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5
EVERY = 199
#: Letters of a group's words that one task composes at once; larger groups are cut again.
GROUP_CHARS = 1 << 20
#: Distinct words that a task counts before it hands them on.
ROOM = 200_000
#: Texts of more characters are searched run by run.
LONG = 1 << 22
#: No limit on the first differing letter of a pair.
ANYWHERE = 2**31 - 1
#: Runs of letters in ASCII-lowered texts.
RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(row_id: str, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text after the seeded deletions, with their numbers of times."""
    low = text.encode().translate(LOWER).decode()
    runs = Counter(RUN.findall(low) if len(low) < LONG else (m[0] for m in RUN.finditer(low)))
    start = zlib.crc32(f"{row_id}:".encode())
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            for word, n in words_of(row_id, text):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > room:
                yield rows()
                counts = {}
    yield rows()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, room: int = ROOM) -> DataFrame:
    """word, n of the words of ``docs`` (doc_id, text)."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    found = spread(texts).mapInArrow(lambda it: _counted(it, room), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """Minimised acyclic acceptors that share their states: ``arcs[s]`` leads from state s by letter,
    ``final[s]`` tells whether the empty word is accepted there."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._numbers: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], list[str]] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return number

    def initial(self, words: Iterable[str]) -> int:
        """State from which just these words (in order, distinct) are accepted."""
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(upto: int) -> None:
            while len(path) > upto + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(final[0], arcs)

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            path.extend(([False], {}) for _ in range(len(word) - same))
            path[-1][0][0] = True
            last = word
        close(0)
        return self._state(path[0][0][0], path[0][1])

    def shared(self, p: int, q: int) -> list[str]:
        """Words accepted from both states."""
        known = self._shared.get((p, q))
        if known is not None:
            return known
        found: list[str] = []
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            a, b, depth, letter = stack.pop()
            if depth:
                path[depth - 1 :] = [letter]
            if self.final[a] and self.final[b]:
                found.append("".join(path[:depth]))
            other = self.arcs[b]
            for x, to in self.arcs[a].items():
                if x in other:
                    stack.append((to, other[x], depth + 1, x))
        self._shared[p, q] = found
        return found

    def one_edit_apart(self, start: int, length: int, limit: int) -> Iterator[tuple[str, str]]:
        """The composition's accepted pairs from ``start``: words of ``length`` letters with one replaced
        (each pair once), and words of ``length`` letters with those that have one more, whose first
        differing letter comes before ``limit``."""
        path: list[str] = []
        stack = [(start, 0, "")]
        while stack:
            p, depth, letter = stack.pop()
            if depth:
                path[depth - 1 :] = [letter]
            if depth >= limit:
                continue
            before, arcs = "".join(path[:depth]) if len(self.arcs[p]) > 1 else None, list(self.arcs[p].items())
            for i, (x, q) in enumerate(arcs):
                for rest in self.shared(p, q):
                    # a rest that begins with x agrees with the longer word for one more letter
                    if depth + len(rest) == length and rest[:1] != x:
                        before = "".join(path[:depth]) if before is None else before
                        yield before + rest, before + x + rest
                for y, r in arcs[i + 1 :]:
                    for rest in self.shared(q, r):
                        if depth + 1 + len(rest) == length:
                            yield before + x + rest, before + y + rest
                stack.append((q, depth + 1, x))


def _composed(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; out go, for words that have near words, their number and the one of
    largest n (ties: least). Acceptors of a chunk of groups share their states."""
    group, members = None, []
    acceptor, letters = Acceptor(), 0
    near: dict[str, list] = {}

    def take(word: str, other: str, n: int) -> None:
        best = near.get(word)
        if best is None:
            near[word] = [1, n, other]
            return
        best[0] += 1
        if n > best[1] or n == best[1] and other < best[2]:
            best[1:] = n, other

    def compose() -> None:
        nonlocal letters
        if len(members) < 2:
            return
        m, lo, hi, lim, begin, end = group
        open_to = -hi or None
        counts = {w[lo:open_to]: n for w, n in members}
        start = acceptor.initial(sorted(counts))
        for u, v in acceptor.one_edit_apart(start, m - lo - hi, lim - lo):
            a, b = begin + u + end, begin + v + end
            take(a, b, counts[v])
            take(b, a, counts[u])
        letters += sum(map(len, counts))

    def rows() -> pa.RecordBatch:
        found = list(near.values())
        columns = [pa.array(list(near), pa.string()), *(pa.array([x[i] for x in found], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near"])

    for batch in batches:
        for m, lo, hi, lim, word, n in zip(*(batch.column(c).to_pylist() for c in ("m", "lo", "hi", "lim", "word", "n"))):
            now = (m, lo, hi, lim, word[:lo], word[len(word) - hi :])
            if now != group:
                compose()
                group, members = now, []
                if letters > chunk:
                    yield rows()
                    acceptor, letters, near = Acceptor(), 0, {}
            members.append((word, n))
    compose()
    yield rows()


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, lo, hi, lim) under both halves of what is open between the first ``lo``
    and the last ``hi`` letters."""
    half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    first = F.struct((F.col("lo") + half).alias("lo"), "hi", "lim")
    last = F.struct("lo", (F.col("hi") + half).alias("hi"), F.least("lim", F.col("lo") + half).alias("lim"))
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "m", "x.*").filter("lo < lim")


def initial_states(words: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, n, m, lo, hi, lim, begin, end: each word (word, n) in the groups in which it is composed."""
    length = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).withColumns(
        {"lo": F.lit(0), "hi": F.lit(0), "lim": F.lit(ANYWHERE)}
    )
    open_rows, done = roles.filter(F.col("m") >= 1), None
    key = ["m", "lo", "hi", "lim", "begin", "end"]
    while True:
        grouped = _halved(open_rows).withColumns(
            {"begin": F.expr("substring(word, 1, lo)"), "end": F.expr("substring(word, length(word) - hi + 1, hi)")}
        )
        grouped = written(grouped)
        large = written(
            grouped.groupBy(*key).agg(F.sum(length).alias("chars")).filter((F.col("chars") > group_chars) & (F.col("m") - F.col("lo") - F.col("hi") >= 2)).drop("chars")
        )
        if large.isEmpty():
            return grouped if done is None else done.unionByName(grouped)
        small = grouped.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        open_rows = grouped.join(large, key, "left_semi")


def near_words(words: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, n_near, near_n, near: for each word (word, n) with near words their number and the one of
    largest n (ties: the least)."""
    key = ["m", "lo", "hi", "lim", "begin", "end"]
    groups = initial_states(words, group_chars).repartition(*key).sortWithinPartitions(*key, "word")
    found = groups.mapInArrow(lambda it: _composed(it, group_chars), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (``forms``: word, form)."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text)."""
    words = written(vocabulary(docs, least_count))
    near = near_words(words, group_chars)
    better = F.col("near_n") >= ratio * F.col("n")
    with_forms = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _roots(with_forms.filter(F.col("form").isNotNull()))
    return with_forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_variants(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: crc32 over bytes, from its 256 remainders; near words by their strings with one letter deleted.
ORACLE = f"""
WITH RECURSIVE remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), marked AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) AS h
  FROM counted, remainders
), made AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM marked
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS less
  FROM words, unnest(range(1, length(word) + 1)) u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word
), best AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS r FROM near
), formed AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN b.n >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.r = 1
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""

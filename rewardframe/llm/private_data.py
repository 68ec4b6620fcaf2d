"""Personal data by bootstrapped contextual extraction.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers by their forms. These are
the seeds. The words around them induce lexical patterns, and patterns in whose slot mostly personal
data stand find identifiers that the forms miss (a phone number without +, an address spelled with
"(at)", a card number with a misread digit).

* Mentions: the base spans, and other candidates: tokens with digits or @, runs of such number tokens,
  addresses with a spelled-out at. A mention's instance is its text without separators.
* Patterns: the word before (L1), the two before (L2), the word after (R1), the two after (R2), and the
  words on both sides (LR), lower-cased. Only those with SUPPORT distinct instances can ever count.
* Graph: pattern and instance are linked by their common mentions. A pattern's confidence in a kind is
  the weight of its instances of that kind over all places in the corpus where its words stand,
  whatever stands in the slot; so "the _" finds nothing. A new instance scores as its best pattern of
  CONFIDENCE or more, if its shape can be of that kind, and counts for other patterns at the next round,
  until nothing new is found (ROUNDS at most).
* All mentions of instances found that way become spans of their kind. Base spans stay as they are.

Plan: one pass over the texts writes a row for each document (base spans) and each mention; only
candidates' surroundings are written, no texts. Patterns with support are counted in a second pass; a task
recognises them by a Bloom filter of fixed size (2^BLOOM bits), and what passes wrongly goes in the join
with the patterns. Patterns that could not reach CONFIDENCE if all their candidates were personal data
go before the rounds, which are small joins and sums. Nothing but the filter and counts reaches the
driver.

Defined results: a null or empty text has no spans; documents are rows, so repeated ids are answered one
by one, null ids too; texts may have any length (time is linear in it); a candidate has at most LONGEST
and a context word at most WORD_CHARS characters, longer ones are neither; an empty table gives no rows;
other columns are not read. Of kinds with equal scores the first listed counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import written
from rewardframe.session import spread

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.7, 5
LONGEST, WORD_CHARS = 64, 40
BLOOM = 23
#: Distinct word groups that a task counts before it hands them on.
ROOM = 200_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts at the first digit of a run: a later start fails where the first one does.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

#: An address whose at or dots are spelled out.
SPELLED_MARK = re.compile(r"[(\[{] ?at ?[)\]}]| at | dot ", re.IGNORECASE)
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,40}(?: ?[(\[{] ?at ?[)\]}] ?| at |@)"
    r"[A-Za-z0-9-]{1,40}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,20})+",
    re.IGNORECASE,
)
HIT = re.compile(r"[0-9@]")
TOKEN_END = re.compile(rf"\S{{0,{LONGEST + 1}}}")
LABEL = re.compile(r"[^0-9@]*[:=]")
NUMBER = re.compile(r"[+(]*[0-9][0-9().\-/]*")
MORE_NUMBERS = re.compile(r"(?: [(]?[0-9][0-9().\-/]*)*")
EDGES = " .,;:!?\"'()[]{}<>|"
SEPARATORS = re.compile(r"[ ().\-/]")

#: What an instance must look like to be of a kind (instances of numbers have no separators).
SHAPES = {
    EMAIL: r"(@|[(\[{] ?at ?[)\]}]| at )",
    IP: r"^[0-9a-f]*([.:]+[0-9a-f]*){2,}$",
    CARD: r"^[0-9]{12,19}$",
    PHONE: r"^\+?[0-9]{6,15}$",
}

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four forms: leftmost and not overlapping for each kind; a match that fails its
    check is dropped and its characters are spent."""
    out: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in NAME_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, EMAIL, m.end()))
            end = m.end()
    for m in DOTTED.finditer(text):
        # leading zeros aside, a part of over three digits is above 255
        if all(len(x) <= 3 and int(x) <= 255 for x in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), IP, m.end()))
    for m in DIGITS.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in PLUS.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Start and end of what else could be an identifier, left to right, apart from the base spans."""
    found: list[tuple[int, int]] = []
    taken = sorted((s, e) for s, _, e in base)
    if SPELLED_MARK.search(text):
        found += [m.span() for m in SPELLED.finditer(text)]
        taken = sorted(taken + found)
    at, done = 0, 0
    for hit in HIT.finditer(text):
        p = hit.start()
        if p < done:
            continue
        while at < len(taken) and taken[at][1] <= p:
            at += 1
        if at < len(taken) and taken[at][0] <= p:
            done = taken[at][1]
            continue
        before = text[max(done, p - LONGEST) : p]
        start = p - (len(before.split()[-1]) if before and not before[-1].isspace() else 0)
        stop = done = TOKEN_END.match(text, p).end()
        if at and taken[at - 1][1] > start:
            start = taken[at - 1][1]
        if stop - start > LONGEST:
            continue
        label = LABEL.match(text, start, stop)
        start = label.end() if label else start
        number = NUMBER.match(text, start)
        if number and number.end() == stop:
            stop = done = MORE_NUMBERS.match(text, stop).end()
        while start < stop and text[start] in EDGES and text[start] != "(":
            start += 1
        while start < stop and text[stop - 1] in EDGES:
            stop -= 1
        if at < len(taken) and taken[at][0] < stop or not 0 < stop - start <= LONGEST:
            continue
        found.append((start, stop))
    return sorted(x for x in found if not any(s < x[1] and x[0] < e for s, _, e in base)) if base else sorted(found)


def instance_of(text: str) -> str:
    """A mention's text, lower-cased; numbers without separators, but dotted ones."""
    low = text.lower()
    bare = SEPARATORS.sub("", low)
    dotted = low.count(".") == 3 and " " not in low and "-" not in low
    return low if dotted or not bare.lstrip("+").isdigit() else bare


def around(text: str, start: int, end: int) -> list[str]:
    """The two words before (nearest last) and the two after, lower-cased; empty where there is none."""
    reach = 3 * WORD_CHARS
    left = text[max(0, start - reach) : start]
    before = left.split()
    if start > reach and before and not left[0].isspace():
        before = before[1:]  # cut by the window
    right = text[end : end + reach]
    after = right.split()
    if end + reach < len(text) and after and not right[-1].isspace():
        after = after[:-1]
    near = ["", "", *before][-2:] + [*after, "", ""][:2]
    return [w.lower() if len(w) <= WORD_CHARS else "" for w in near]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (base spans) and for each of its mentions."""
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    names = ["row", "doc_id", "base", "start", "end", "kind", "instance", "l2", "l1", "r1", "r2"]
    texts_as = [pa.string()] * 5

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        mentions: list[tuple] = []
        bases: list[list[dict]] = []
        first = row
        for text in texts:
            spans: list[Span] = []
            if text and (HIT.search(text) or SPELLED_MARK.search(text)):
                spans = base_spans(text)
                for start, kind, end in spans:
                    mentions.append((row, start, end, kind, instance_of(text[start:end]), *around(text, start, end)))
                for start, end in candidates(text, spans):
                    mentions.append((row, start, end, None, instance_of(text[start:end]), *around(text, start, end)))
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            row += 1
        n = len(texts)
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), *texts_as)]
        yield pa.RecordBatch.from_arrays([pa.array(range(first, row), pa.int64()), ids, pa.array(bases, pa.list_(span)), *empty], names=names)
        if mentions:
            by_column = list(zip(*mentions))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *texts_as]
            columns = [pa.array(x, t) for x, t in zip(by_column, kinds)]
            m = len(mentions)
            yield pa.RecordBatch.from_arrays([columns[0], pa.nulls(m, ids.type), pa.nulls(m, pa.list_(span)), *columns[1:]], names=names)


def _patterns() -> Column:
    """The patterns of a mention as an array of texts: a form and its words."""
    def form(name: str, *words: str) -> Column:
        there = F.lit(True)
        for w in words:
            there = there & (F.col(w) != "")
        return F.when(there, F.concat_ws(" ", F.lit(name), *words))

    return F.array_compact(F.array(form("L1", "l1"), form("L2", "l2", "l1"), form("R1", "r1"), form("R2", "r1", "r2"), form("LR", "l1", "r1")))


#: Word groups are counted by kind: single words, pairs, and pairs around a place.
GROUP_OF = {"L1": "U", "R1": "U", "L2": "B", "R2": "B", "LR": "S"}


class Marked(dict):
    """Which texts the Bloom filter holds; remembers what it was asked."""

    def __init__(self, words: np.ndarray) -> None:
        super().__init__()
        self.words = words

    def has(self, key: str) -> bool:
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        for bit in (h & (1 << BLOOM) - 1, h >> 32 & (1 << BLOOM) - 1):
            if not int(self.words[bit >> 6]) >> (bit & 63) & 1:
                return False
        return True

    def __missing__(self, key: str) -> bool:
        if len(self) > ROOM:
            self.clear()
        self[key] = has = self.has(key)
        return has


class Heads(Marked):
    """For a word: 1 if it counts by itself, 2 if it begins a group of two."""

    def __missing__(self, word: str) -> int:
        if len(self) > ROOM:
            self.clear()
        self[word] = flag = self.has("U " + word) + 2 * self.has("H " + word)
        return flag


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Times that the marked word groups stand in the texts."""
    heads, pairs = Heads(bits), Marked(bits)
    counts: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["words", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = text.lower().split()
            last = len(words) - 1
            for i, flag in enumerate(map(heads.__getitem__, words)):
                if not flag:
                    continue
                word = words[i]
                if flag & 1:
                    key = "U " + word
                    counts[key] = counts.get(key, 0) + 1
                if flag & 2 and i < last:
                    for key in (f"B {word} {words[i + 1]}", f"S {word} {words[i + 2]}" if i + 1 < last else ""):
                        if key and pairs[key]:
                            counts[key] = counts.get(key, 0) + 1
            if len(counts) > ROOM:
                yield rows()
                counts = {}
    yield rows()


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of ``key``, as 64-bit words; at most 2^BLOOM bits reach the driver."""
    h, mask = F.xxhash64("key"), F.lit((1 << BLOOM) - 1)
    bits = keys.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).collect()
    out = np.zeros(1 << BLOOM - 6, dtype=np.uint64)
    for r in words:
        out[r["at"]] = r["word"] & (1 << 64) - 1
    return out


def context_patterns(mentions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (pattern, instance, n) and totals (pattern, places) of the patterns that have SUPPORT distinct
    instances and could reach CONFIDENCE."""
    links = written(
        mentions.select("instance", F.explode(_patterns()).alias("pattern")).groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"))
    )
    known = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("seen")).filter(F.col("instances") >= SUPPORT)
    form, words = F.substring("pattern", 1, 2), F.expr("substring(pattern, 4)")
    group = F.concat_ws(" ", F.element_at(F.create_map(*(F.lit(x) for kv in GROUP_OF.items() for x in kv)), form), words)
    known = written(known.select("pattern", "seen", group.alias("words")))
    keys = known.select(F.col("words").alias("key")).unionByName(
        known.filter(~F.col("words").startswith("U ")).select(F.concat(F.lit("H "), F.split("words", " ")[1]).alias("key"))
    )
    bits = _bloom(keys)
    counted = spread(docs.filter(F.length("text") > 0).select("text")).mapInArrow(lambda it: _counted(it, bits), "words string, n long")
    places = counted.groupBy("words").agg(F.sum("n").alias("places"))
    totals = written(
        known.join(places, "words", "left").select("pattern", "seen", F.greatest("seen", F.coalesce("places", F.lit(0))).alias("places"))
        .filter(F.col("seen") >= CONFIDENCE * F.col("places"))
        .select("pattern", "places")
    )
    return written(links.join(totals.select("pattern"), "pattern")), totals


def found_instances(mentions: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Instances found by their contexts (instance, kind, score) and the patterns of high confidence
    (pattern, kind, confidence, support)."""
    links, totals = context_patterns(mentions, docs)
    seeds = written(mentions.filter(F.col("kind").isNotNull()).select("instance", "kind", F.lit(1.0).alias("score")).distinct())
    fits = F.lit(False)
    for kind, shape in SHAPES.items():
        fits = fits | (F.col("kind") == kind) & F.col("instance").rlike(shape)
    known, before = seeds, None
    while True:
        weight = F.sum(F.col("n") * F.col("score"))
        patterns = written(
            links.join(known, "instance").groupBy("pattern", "kind").agg(weight.alias("weight"), F.count(F.lit(1)).alias("support"))
            .join(totals, "pattern")
            .select("pattern", "kind", F.least(F.lit(1.0), F.col("weight") / F.col("places")).alias("confidence"), "support")
            .filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        )
        best = F.min(F.struct((-F.col("confidence")).alias("less"), "kind")).alias("best")
        new = written(
            links.join(patterns, "pattern").filter(fits).join(seeds.select("instance"), "instance", "left_anti")
            .groupBy("instance").agg(best)
            .select("instance", F.col("best.kind").alias("kind"), (-F.col("best.less")).alias("score"))
        )
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)")).alias("h")).first()
        rounds -= 1
        if not rounds or not state.n or (state.n, state.h) == before:
            return new, patterns
        known, before = seeds.unionByName(new), (state.n, state.h)


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each row of ``docs`` (doc_id, text): row, doc_id, base and found (arrays of start, kind, end; the
    kind as an index of KINDS); and the patterns that found them."""
    kind = dict(docs.dtypes)["doc_id"]
    span = "array<struct<start:int,kind:int,end:int>>"
    texts = spread(docs.select("doc_id", "text"))
    parts = written(
        texts.mapInArrow(
            _found,
            f"row long, doc_id {kind}, base {span}, start int, end int, kind int, instance string, l2 string, l1 string, r1 string, r2 string",
        )
    )
    mentions = parts.filter(F.col("base").isNull())
    new, patterns = found_instances(mentions, docs)
    others = mentions.filter(F.col("kind").isNull()).drop("kind").join(new.select("instance", "kind"), "instance")
    spans = others.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    rows = parts.filter(F.col("base").isNotNull()).select("row", "doc_id", "base").join(spans, "row", "left")
    return rows.select("row", "doc_id", "base", F.coalesce("found", F.array().cast(span)).alias("found")), patterns


def listed(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def op13_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every document."""
    rows, _ = extract(docs)
    def number(kind: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [number(k, name) for k, name in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )

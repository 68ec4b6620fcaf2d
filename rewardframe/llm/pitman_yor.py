"""Language model: hierarchical Pitman-Yor process over words, each word's context being the word before.

Tokens are ASCII-lowered words and one end for each text.

* P(word | word before): one restaurant for each word before (and one for the text's begin), all sharing a
  parent restaurant over words, whose customers are the tables of its children.
* P(word), the parent: its base is an unbounded vocabulary that gives no word twice, so each known word
  has exactly one table there, and what is left for new words is the probability of the one event
  "unknown word". Its discount is estimated from the numbers of words seen once and twice.
* Gibbs sweeps: each sweep takes all customers of each dish out of its restaurant, their tables out of
  the parent, and seats them anew given all the rest as the sweep before left it (see ``restaurants``;
  the dishes of one sweep are drawn side by side). The strength shared by all contexts is drawn after
  each sweep, under a Gamma(1, 1) prior. Predictive probabilities are averaged over the sweeps after
  BURN.

In each kept sweep
    P(w | u) = (c_uw - d t_uw) / (s + c_u) + (s + d t_u) / (s + c_u) P(w),   P(w) = (c_w - D) / (S + c),
and the unknown word has P = (S + D V) / (S + c) in place of P(w); so the probabilities of all known words
and of the unknown one add up to 1 after every word, known or not. A token's score comes from the mean.

Plan: words are numbered by the rank of their 64-bit hash, by which they are told apart: blocks of
BLOCK_TOKENS send their words to ranges of hashes, which answer with numbers. A block then sends its
distinct pairs once, as packed columns, to the pair's bucket (a hash of the word
before, and of the word's high bits, so a common word's followers are spread, over the more buckets the
more there are); there the counts of all blocks meet. A block handles the pairs of PIECE_TOKENS tokens at
a time, bucket after bucket, both when it sends them and when it scores them: besides its texts, it holds
a few bytes for each token and the totals of its words. Pairs that occur once have one table in every sweep and are not drawn again; the others stay
in their buckets. Between sweeps only sums by word travel: buckets send their tables to the ranges of
words, which hold the restaurants' and the parent's totals, and get back what they asked about. At the
end each bucket answers the blocks' lists in their order, and ranges answer with the words' totals.
All that is sent are rows addressed by bucket, range or block, shuffled by Spark; a superseded table is
deleted, and shuffle files are released step by step. Counts and sums over the whole corpus alone reach
the driver. Draws are hashes of the sweep and the pair, so reruns agree.

Defined results: a null or empty text is one end token; a null id is not held out; without training
texts the unknown word has probability 1; tables may be empty; rows with the same id count each; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.llm.common import LOWER, Numbers, discard, fold, release, written
from rewardframe.llm.pieces import mix_bits
from rewardframe.llm.restaurants import DISCOUNT, strength_sums, table_draws

FOLDS, HELD_OUT = 5, 1
BLOCK_TOKENS = 3_000_000
#: Tokens of texts that are sent in one row.
TEXT_TOKENS = 1 << 18
#: Training tokens for each bucket of pairs, and the most buckets.
BUCKET_TOKENS, MOST_BUCKETS = 1 << 21, 1 << 16
#: Tokens whose pairs a block handles at once.
PIECE_TOKENS = 1 << 19
#: Followers of one word that share a bucket: those whose numbers agree but for so many bits at most; and
#: fewer, if that spreads them over less than this part of the buckets.
NEAR_BITS, SPREAD = 22, 32
#: Words of a range, and the most ranges of hashes.
RANGE, MOST_HASHES = 1 << 16, 1 << 16
#: Values of one row at most.
ROW = 1 << 17
SWEEPS, BURN = 4, 1
#: The contexts' first strength and the parent's.
STRENGTH = 1.0
SEED = 99
#: The end token: no word holds a space.
END = b" "
#: Stands for the word before a text's first token: no word is empty.
BEGIN = b""

# Kinds of rows, by address.
DICTIONARY, VOCABULARY = range(2)  # to a range of hashes
TEXTS, LOCALS, IDS, STATES, ANSWERS = range(5)  # to a block
PAIRS, SEATED, REPLY_BEFORE, REPLY_WORD = range(4)  # to a bucket
STATE, COUNTS, SUMS_BEFORE, SUMS_WORD, TABLES_BEFORE, TABLES_WORD, ASKED = range(7)  # to a range
STATS = 99
#: What a row is addressed to.
HASHES, BLOCK, BUCKET, WORDS = "hashes", "block", "bucket", "words"
LETTER = (
    "address string, to long, kind int, origin long, seq int, m int, a binary, b binary, c binary, d binary, "
    "x double, y double, z double, w double"
)
#: Rows of a range's state: training count, customers and single dishes of the restaurant after the word,
#: restaurants where the word is a single dish; then tables and customers in the parent for each kept sweep.
TOTALS = 4


# ------------------------------------------------------------------ rows sent between tasks

class Letters:
    """Rows of the shape LETTER, gathered into batches, their arrays packed."""

    names = [x.split()[0] for x in LETTER.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.float64()] * 4]

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, address: str, to: int, kind: int, origin: int, *parts: np.ndarray, stats: tuple = (None,) * 4, seq: int = 0) -> None:
        """``parts``: arrays of m columns; long ones make several rows, numbered from ``seq``."""
        m = parts[0].shape[-1] if parts else 0
        for seq, a in enumerate(range(0, max(m, 1), ROW), seq):
            packed = [_packed(p[..., a : a + ROW]) for p in parts] + [None] * (4 - len(parts))
            self.size += sum(len(p) for p in packed if p)
            self.rows.append((address, to, kind, origin, seq, min(m - a, ROW), *packed, *stats))

    def add_by_range(self, kind: int, origin: int, ids: np.ndarray, values: np.ndarray) -> None:
        """``ids`` in order, ``values`` a column for each: a row for each range of words."""
        edges = [0, *(np.flatnonzero(np.diff(ids // RANGE)) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                self.add(WORDS, int(ids[a] // RANGE), kind, origin, ids[a:b], values[:, a:b])

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > 1 << 23:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], t) for i, t in enumerate(self.types)], names=self.names)
        self.rows, self.size = [], 0


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest one takes (the first byte tells), the bytes of equal
    weight side by side and compressed: the high ones are mostly equal."""
    if x.dtype != np.uint64:  # hashes keep all of theirs
        most = int(x.max()) if x.size else 0
        x = x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T if x.size else x
    return bytes([size]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, m: int, rows: int = 1, kind: type = np.int64) -> np.ndarray:
    """Whole numbers of a row: m columns."""
    if not m or not rows:
        return np.empty((rows, m), dtype=kind)
    planes = np.frombuffer(pa.decompress(x[1:], decompressed_size=m * rows * x[0], codec="zstd", asbytes=True), dtype=np.uint8)
    flat = np.ascontiguousarray(planes.reshape(x[0], -1).T).view(f"<u{x[0]}")
    return flat.reshape(rows, m).astype(kind)


def _in_order(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by word before, then word."""
    if max(int(before.max(initial=0)), int(word.max(initial=0))) >= 1 << 32:
        return np.lexsort((word, before))
    keys = before.astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= word.view(np.uint64)
    return np.argsort(keys, kind="stable")


def _addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[pa.RecordBatch]]]]:
    """Rows sorted by ``to`` and ``kind``: what came to each address, by kind."""
    now, got = None, {}
    for batch in batches:
        to, kinds = np.asarray(batch.column("to")), np.asarray(batch.column("kind"))
        edges = (np.flatnonzero((np.diff(to) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(to)]):
            if a == b:
                continue
            if to[a] != now:
                if got:
                    yield now, got
                now, got = int(to[a]), {}
            got.setdefault(int(kinds[a]), []).append(batch.slice(a, b - a))
    if got:
        yield now, got


def _letters(got: dict[int, list[pa.RecordBatch]], kind: int) -> list[dict]:
    """Rows of one kind by their sender and in the order in which it wrote them, taken from what came."""
    return sorted((row for part in got.pop(kind, []) for row in part.to_pylist()), key=lambda r: (r["origin"], r["seq"]))


def _column(rows: list[dict], name: str, height: int = 1) -> np.ndarray:
    """The rows' arrays one after another; of one row each if ``height`` is 1."""
    parts = [_unpacked(r[name], r["m"], height) for r in rows]
    out = np.concatenate(parts, axis=1) if parts else np.empty((height, 0), dtype=np.int64)
    return out[0] if height == 1 else out


def _sent(rows: DataFrame, run: Callable, addresses: int, schema: str = LETTER) -> DataFrame:
    """``rows`` brought to their addresses, whose tasks ``run`` them; many small addresses share a task."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(2, min(2 * addresses, max(usual, addresses // 16))), "to").sortWithinPartitions("to", "kind")
    return dealt.mapInArrow(run, schema)


# ------------------------------------------------------------------ blocks

def _numbered(batches: Iterator[pa.RecordBatch], block_tokens: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each block: its distinct words' hashes and training counts (to their ranges of hashes; BEGIN is
    one of the words), their local numbers in the order of the hashes and its texts as local numbers
    (to itself)."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 24
    known, kept, out = Numbers(), [], Letters()

    def with_texts(letters: pa.RecordBatch, ids: pa.Array | None = None) -> pa.RecordBatch:
        more = pa.nulls(letters.num_rows, pa.list_(id_type)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([*letters.columns, more], names=[*Letters.names, "doc_ids"])

    def flush() -> Iterator[pa.RecordBatch]:
        learned = [x for _, held, numbers in kept for h, x in zip(held, numbers) if not h]
        counts = np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *learned]), minlength=len(known) + 1)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in [*known, BEGIN]], dtype=np.uint64)
        order = np.argsort(hashes)
        ranges = (hashes[order] >> np.uint64(64 - bits)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in zip(edges, edges[1:]):
            out.add(HASHES, int(ranges[a]), DICTIONARY, block, hashes[order[a:b]], counts[order[a:b]])
        out.add(BLOCK, block, LOCALS, block, order)
        for letters in out.rest():
            yield with_texts(letters)
        seq = 0
        for ids, held, numbers in kept:
            for a, b in _stretches(np.array([len(x) for x in numbers]), TEXT_TOKENS):
                part = np.concatenate(numbers[a:b])
                out.rows.append((BLOCK, block, TEXTS, block, seq, b - a, _packed(part), _packed(np.array([len(x) for x in numbers[a:b]])), _packed(np.array(held[a:b])), None, *[None] * 4))
                for letters in out.rest():
                    yield with_texts(letters, ids.slice(a, b - a))
                seq += 1

    tokens = 0
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        held = batch.column("held").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        first, numbers = 0, []
        for i, text in enumerate(texts):
            x = np.fromiter(map(known.__getitem__, [*(text or b"").translate(LOWER).split(), END]), dtype=np.int32)
            numbers.append(x)
            tokens += len(x)
            if tokens >= block_tokens:
                kept.append((batch.column("doc_id").slice(first, i + 1 - first), held[first : i + 1], numbers))
                yield from flush()
                block, known, kept, tokens, first, numbers = block + 1, Numbers(), [], 0, i + 1, []
        if numbers:
            kept.append((batch.column("doc_id").slice(first), held[first:], numbers))
    if kept:
        yield from flush()


# ------------------------------------------------------------------ ranges of hashes

def _hashes(row: dict) -> np.ndarray:
    return _unpacked(row["a"], row["m"], kind=np.uint64)[0]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range its distinct hashes in order and their counts; and how many words it has, training
    tokens, known words, those seen once and twice."""
    out = Letters()
    for at, got in _addressed(batches):
        rows = _letters(got, DICTIONARY)
        hashes, of = np.unique(np.concatenate([_hashes(r) for r in rows]), return_inverse=True)
        counts = np.zeros(len(hashes), dtype=np.int64)
        np.add.at(counts, of, _column(rows, "b"))
        out.add(HASHES, at, VOCABULARY, at, hashes, counts)
        seen = (float(x) for x in (counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()))
        out.add(HASHES, at, STATS, len(hashes), stats=tuple(seen))
        yield from out.full()
    yield from out.rest()


def _placed(batches: Iterator[pa.RecordBatch], offsets: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """To each block the numbers of its words of a range, in the order of the hashes; to the ranges of
    words their counts."""
    out = Letters()
    for at, got in _addressed(batches):
        rows = _letters(got, VOCABULARY)
        hashes, counts = np.concatenate([_hashes(r) for r in rows]), _column(rows, "b")
        ids = offsets[at] + np.arange(len(hashes))
        out.add_by_range(COUNTS, at, ids, counts[None])
        for row in _letters(got, DICTIONARY):
            out.add(BLOCK, row["origin"], IDS, at * MOST_HASHES + row["seq"], ids[np.searchsorted(hashes, _hashes(row))])
            yield from out.full()
    yield from out.rest()


def _stretches(sizes: np.ndarray, tokens: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most so many tokens, or one row."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - sizes[a] + tokens, "right")))
        yield a, b
        a = b


def _text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of texts: their tokens' local numbers, their lengths, and which are held out."""
    lengths = _unpacked(row["b"], row["m"])[0]
    return _unpacked(row["a"], int(lengths.sum()), kind=np.int32)[0], lengths, _unpacked(row["c"], row["m"])[0].astype(bool)


def _bucket_of(before: np.ndarray, word: np.ndarray, buckets: int, near: int) -> np.ndarray:
    h = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (word >> near).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16)


def _block_ids(got: dict[int, list[pa.RecordBatch]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's words in order, and the place there of each local number."""
    order, ids = _column(_letters(got, LOCALS), "a"), _column(_letters(got, IDS), "a")
    place = np.empty(len(ids), dtype=np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    return ids, place


def _block_tokens(texts: list[dict], ids: np.ndarray, place: np.ndarray, buckets: int, near: int) -> tuple[np.ndarray, ...]:
    """Of a block's texts: for each token the word before and the word, as places in ``ids``, whether it is
    learned from, and the bucket of its pair."""
    rows = []
    for row in texts:
        local, lengths, held = _text(row)
        word = place[local]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.cumsum(lengths) - lengths] = place[-1]  # the begin is the last local number
        rows.append((before, word, np.repeat(~held, lengths), _bucket_of(ids[before], ids[word], buckets, near)))
    return tuple(np.concatenate(x) for x in zip(*rows))


def _pieces(before: np.ndarray, word: np.ndarray, bucket: np.ndarray, words: int, piece_tokens: int) -> Iterator[tuple]:
    """A block's distinct pairs by buckets, those of so many tokens at a time: the tokens' places, the pair
    of each; the pairs' words before, words and buckets, in the order of bucket, word before and word; and
    the number of the first row that a bucket gets. A bucket of more tokens comes in several pieces, and a
    pair may be in more than one of them."""
    for a, b in _stretches(np.bincount(bucket), piece_tokens):
        places = np.flatnonzero((bucket >= a) & (bucket < b))
        for part, c in enumerate(range(0, len(places), piece_tokens)):
            at = places[c : c + piece_tokens]
            keys = before[at].astype(np.int64)
            keys *= words
            keys += word[at]
            keys, of = np.unique(keys, return_inverse=True)
            to = np.empty(len(keys), dtype=bucket.dtype)
            to[of] = bucket[at]
            order = np.argsort(to, kind="stable")
            turn = np.empty(len(keys), dtype=np.int64)
            turn[order] = np.arange(len(keys))
            yield at, turn[of], *np.divmod(keys[order], words), to[order], part * -(-piece_tokens // ROW)


def _paired(batches: Iterator[pa.RecordBatch], buckets: int, near: int, piece_tokens: int) -> Iterator[pa.RecordBatch]:
    """For each block: its pairs (to their buckets), the words it asks about (to their ranges)."""
    out = Letters()
    for block, got in _addressed(batches):
        yield from _block_pairs(out, block, got, buckets, near, piece_tokens)
    yield from out.rest()


def _block_pairs(out: Letters, block: int, got: dict[int, list[pa.RecordBatch]], buckets: int, near: int, piece_tokens: int) -> Iterator[pa.RecordBatch]:
    ids, place = _block_ids(got)
    before, word, learned, bucket = _block_tokens(_letters(got, TEXTS), ids, place, buckets, near)
    for at, of, first, second, to, seq in _pieces(before, word, bucket, len(ids), piece_tokens):
        n = np.bincount(of[learned[at]], minlength=len(to))
        edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        for a, b in zip(edges, edges[1:]):
            out.add(BUCKET, int(to[a]), PAIRS, block, ids[first[a:b]], ids[second[a:b]], n[a:b], seq=seq)
            yield from out.full()
    out.add_by_range(ASKED, block, ids, np.empty((0, len(ids)), dtype=np.int64))
    yield from out.full()


# ------------------------------------------------------------------ buckets of pairs

def _meeting(got: dict[int, list[pa.RecordBatch]]) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks' lists, and for a bucket's distinct pairs in order: words before, words, times; the pair
    of each place of the lists one after another."""
    lists = _letters(got, PAIRS)
    before, word, n = (_column(lists, c) for c in "abc")
    order = _in_order(before, word)
    before, word = before[order], word[order]
    new = np.concatenate(([True], (np.diff(before) != 0) | (np.diff(word) != 0)))
    starts = np.flatnonzero(new)
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return lists, before[starts], word[starts], np.add.reduceat(n[order], starts), of


def _by_word(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the sums of whole-number values by them."""
    distinct, of = np.unique(ids, return_inverse=True)
    sums = np.zeros((len(values), len(distinct)), dtype=np.int64)
    for row, v in zip(sums, values):
        np.add.at(row, of, v)
    return distinct, sums


def _tell_tables(out: Letters, bucket: int, before: np.ndarray, word: np.ndarray, tables: np.ndarray) -> None:
    for kind, ids in ((TABLES_BEFORE, before), (TABLES_WORD, word)):
        out.add_by_range(kind, bucket, *_by_word(ids, tables))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket: the pairs seen more than once, with one table each; sums to the ranges."""
    out = Letters()
    for bucket, got in _addressed(batches):
        _, before, word, n, _ = _meeting(got)
        before, word, n = before[n > 0], word[n > 0], n[n > 0]
        once = (n == 1).astype(np.int64)
        out.add_by_range(SUMS_BEFORE, bucket, *_by_word(before, n, once))
        out.add_by_range(SUMS_WORD, bucket, *_by_word(word[n == 1], once[n == 1]))
        before, word, n = before[n > 1], word[n > 1], n[n > 1]
        if len(n):
            out.add(BUCKET, bucket, SEATED, bucket, before, word, n, np.ones((1, len(n)), dtype=np.int64))
            _tell_tables(out, bucket, before, word, np.ones(len(n), dtype=np.int64))
        yield from out.full()
    yield from out.rest()


def _replies(got: dict[int, list[pa.RecordBatch]], kind: int, ids: np.ndarray) -> np.ndarray:
    """What the ranges reply about each of ``ids``."""
    rows = _letters(got, kind)
    return _column(rows, "b")[np.searchsorted(_column(rows, "a"), ids)]


def pair_draws(before: np.ndarray, word: np.ndarray, sweep: int) -> np.ndarray:
    """Uniform draws of a sweep for pairs of word numbers."""
    salt = np.uint64((SEED * 1000 + sweep) * 0xD1342543DE82EF95 % 2**64)
    return mix_bits(before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt)


def _sampled(batches: Iterator[pa.RecordBatch], sweep: int, strength: float, discount: float, total: int) -> Iterator[pa.RecordBatch]:
    """One sweep over each bucket's dishes."""
    out = Letters()
    for bucket, got in _addressed(batches):
        rows = _letters(got, SEATED)
        before, word, n = (_column(rows, c) for c in "abc")
        tables = _column(rows, "d", 1 + max(0, sweep - BURN)).reshape(-1, len(n))
        old = tables[0]
        others = _replies(got, REPLY_BEFORE, before) - old
        own = _replies(got, REPLY_WORD, word) - old
        now = table_draws(n, others, own, total - old, pair_draws(before, word, sweep), strength, discount, STRENGTH)
        kept = np.concatenate((tables[1:], now[None])) if sweep >= BURN else tables[1:]
        out.add(BUCKET, bucket, SEATED, bucket, before, word, n, np.concatenate((now[None], kept)))
        _tell_tables(out, bucket, before, word, now)
        yield from out.full()
    yield from out.rest()


def _answered(batches: Iterator[pa.RecordBatch], sweeps: int) -> Iterator[pa.RecordBatch]:
    """To each block, for its list of pairs: training times and the kept sweeps' tables."""
    out = Letters()
    for bucket, got in _addressed(batches):
        lists, _, _, n, of = _meeting(got)
        tables = np.repeat(np.minimum(n, 1)[None], sweeps, axis=0)
        tables[:, n > 1] = _column(_letters(got, SEATED), "d", 1 + sweeps)[1:]
        at = 0
        for row in lists:
            part = of[at : at + row["m"]]
            at += len(part)
            out.add(BLOCK, row["origin"], ANSWERS, bucket * MOST_HASHES + row["seq"], n[part], tables[:, part])
            yield from out.full()
    yield from out.rest()


# ------------------------------------------------------------------ ranges of words

def _reduced(batches: Iterator[pa.RecordBatch], sweep: int, strength: float) -> Iterator[pa.RecordBatch]:
    """The ranges' totals after ``sweep`` (-1: as first seated), and replies to the buckets about the words
    that they told of. Sums for the driver: customers in the parent, and those of ``strength_sums``."""
    out = Letters()
    for at, got in _addressed(batches):
        first = at * RANGE
        if sweep < 0:
            state = np.zeros((TOTALS, RANGE), dtype=np.int64)
            for kind, rows in ((COUNTS, slice(0, 1)), (SUMS_BEFORE, slice(1, 3)), (SUMS_WORD, slice(3, 4))):
                for r in _letters(got, kind):
                    state[rows, _unpacked(r["a"], r["m"])[0] - first] += _unpacked(r["b"], r["m"], rows.stop - rows.start)
        else:
            state = _column(_letters(got, STATE), "a", TOTALS + 2 * max(0, sweep - BURN))
        sums = {}
        for kind, single in ((TABLES_BEFORE, state[2]), (TABLES_WORD, state[3])):
            sums[kind] = single.copy()
            told = [(r["origin"], r["seq"], *_unpacked(r["a"], r["m"]), *_unpacked(r["b"], r["m"])) for r in _letters(got, kind)]
            for _, _, ids, tables in told:
                sums[kind][ids - first] += tables
            reply = REPLY_BEFORE if kind == TABLES_BEFORE else REPLY_WORD
            for origin, seq, ids, _ in told:
                out.add(BUCKET, origin, reply, at * MOST_HASHES + seq, ids, sums[kind][ids - first])
                yield from out.full()
        if sweep >= BURN:
            state = np.concatenate((state, sums[TABLES_BEFORE][None], sums[TABLES_WORD][None]))
        out.add(WORDS, at, STATE, at, state)
        rng = np.random.default_rng([SEED, sweep + 1, at])
        logs, ones = strength_sums(state[1], sums[TABLES_BEFORE], strength, rng)
        out.add(WORDS, at, STATS, at, stats=(float(sums[TABLES_WORD].sum()), logs, ones, None))
    yield from out.rest()


def _states(batches: Iterator[pa.RecordBatch], sweeps: int) -> Iterator[pa.RecordBatch]:
    """To each block, the totals of the words that it asked about."""
    out = Letters()
    for at, got in _addressed(batches):
        state = _column(_letters(got, STATE), "a", TOTALS + 2 * sweeps)
        for row in _letters(got, ASKED):
            ids = _unpacked(row["a"], row["m"])[0]
            out.add(BLOCK, row["origin"], STATES, at * MOST_HASHES + row["seq"], ids, state[:, ids - at * RANGE])
            yield from out.full()
    yield from out.rest()


# ------------------------------------------------------------------ scoring

class Model:
    """Sums over the corpus: training tokens, distinct words, the parent's discount; for each kept sweep
    the parent's customers and the contexts' strength."""

    def __init__(self, tokens: int, distinct: int, discount: float) -> None:
        self.tokens, self.distinct, self.discount = tokens, distinct, discount
        self.customers: list[float] = []
        self.strengths: list[float] = []

    def new_word(self) -> np.ndarray:
        """The parent's probability of the unknown word, by sweep."""
        return (STRENGTH + self.discount * self.distinct) / (STRENGTH + np.array(self.customers))

    def known_word(self, customers: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with so many customers (a column for each sweep)."""
        return np.maximum(customers - self.discount, 0.0) / (STRENGTH + np.array(self.customers))


def _word_terms(rows: list[dict], words: int, model: Model) -> tuple[np.ndarray, ...]:
    """Of a block's words, in order, from the ranges' answers (which come in that order): whether each is
    known, its base score; for each sweep the customers after it with the strength, the part that goes to
    the parent, and its own probability there."""
    base_total = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    strengths = np.array(model.strengths)
    sweeps = len(strengths)
    seen, base = np.empty(words, dtype=bool), np.empty(words)
    customers, free, parent = (np.empty((words, sweeps)) for _ in range(3))
    a = 0
    for row in rows:
        totals = _unpacked(row["b"], row["m"], TOTALS + 2 * sweeps)
        at = slice(a, a + row["m"])
        a = at.stop
        seen[at] = totals[0] > 0
        base[at] = np.log10(totals[0] + 0.5) - base_total
        customers[at] = totals[1][:, None] + strengths
        free[at] = (strengths + DISCOUNT * totals[TOTALS::2].T) / customers[at]
        parent[at] = np.where(seen[at, None], model.known_word(totals[TOTALS + 1 :: 2].T), model.new_word())
    return seen, base, customers, free, parent


def _next_answers(rows: Iterator[dict], pairs: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the next so many pairs: training times, and tables by sweep."""
    own = []
    while pairs:
        own.append(next(rows))
        pairs -= own[-1]["m"]
    return _column(own, "a"), _column(own, "b", sweeps).reshape(sweeps, -1)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, buckets: int, near: int, piece_tokens: int) -> Iterator[pa.RecordBatch]:
    """Blocks come as texts, their words' numbers, the words' totals and the pairs' answers."""
    for _, got in _addressed(batches):
        yield from _block_scores(got, model, buckets, near, piece_tokens)


def _block_scores(got: dict[int, list[pa.RecordBatch]], model: Model, buckets: int, near: int, piece_tokens: int) -> Iterator[pa.RecordBatch]:
    sweeps = len(model.strengths)
    ids, place = _block_ids(got)
    seen, base, customers, free, parent = _word_terms(_letters(got, STATES), len(ids), model)
    id_type = got[TEXTS][0].schema.field("doc_ids").type.value_type
    texts = _letters(got, TEXTS)
    before, word, _, bucket = _block_tokens(texts, ids, place, buckets, near)
    scores = np.empty(len(word))
    answers = iter(_letters(got, ANSWERS))
    for at, of, first, second, *_ in _pieces(before, word, bucket, len(ids), piece_tokens):
        n, tables = _next_answers(answers, len(first), sweeps)
        chance = sum(
            np.maximum(n - DISCOUNT * tables[s], 0.0) / customers[first, s] + free[first, s] * parent[second, s] for s in range(sweeps)
        ) / sweeps
        scores[at] = np.log10(chance)[of]
    a = 0
    for row in texts:
        _, lengths, held = _text(row)
        starts = np.cumsum(lengths) - lengths
        at = slice(a, a + int(lengths.sum()))
        a = at.stop
        sums = (np.add.reduceat(x, starts) for x in (seen[word[at]].astype(np.int64), base[word[at]], scores[at]))
        columns = [pa.array(row["doc_ids"], id_type), pa.array(held), pa.array(lengths), *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


# ------------------------------------------------------------------ the plan

def _only(letters: DataFrame, address: str, *kinds: int) -> DataFrame:
    return letters.filter((F.col("address") == address) & F.col("kind").isin(*kinds)).select(*Letters.names)


def gibbs(spark: SparkSession, pairs: DataFrame, counts: DataFrame, model: Model, buckets: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Sweeps over all restaurants: the buckets' dishes with the kept sweeps' tables, and the ranges'
    totals; ``model`` gets the sums of the kept sweeps."""
    strength, discount = STRENGTH, model.discount
    seated = written(_sent(pairs, _gathered, buckets))
    release(spark)
    told = _only(seated, WORDS, SUMS_BEFORE, SUMS_WORD, TABLES_BEFORE, TABLES_WORD).unionByName(counts)
    totals = None
    for sweep in range(-1, SWEEPS):
        step, now = sweep, strength
        given = told if totals is None else told.unionByName(_only(totals, WORDS, STATE))
        reduced = written(_sent(given, lambda it: _reduced(it, step, now), ranges))
        if totals is not None:
            discard(totals)
        totals = reduced
        sums = _only(totals, WORDS, STATS).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")).first()
        customers = sums.x or 0.0
        if sweep >= BURN:
            model.customers.append(customers)
            model.strengths.append(strength)
        if sweep >= 0:
            rng = np.random.default_rng([SEED, sweep])
            strength = float(rng.gamma(1.0 + (sums.z or 0.0), 1.0 / (1.0 - (sums.y or 0.0))))
        if sweep < SWEEPS - 1:
            step, now = sweep + 1, strength
            given = _only(seated, BUCKET, SEATED).unionByName(_only(totals, BUCKET, REPLY_BEFORE, REPLY_WORD))
            drawn = written(_sent(given, lambda it: _sampled(it, step, now, discount, int(customers)), buckets))
            discard(seated)
            seated, told = drawn, _only(drawn, WORDS, TABLES_BEFORE, TABLES_WORD)
        release(spark)
    return _only(seated, BUCKET, SEATED), _only(totals, WORDS, STATE)


def score_texts(docs: DataFrame, held_out: Column, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``
    (doc_id, text), learned from the rows that ``held_out`` does not hold for."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    narrow = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    bits = min(MOST_HASHES, 2 * max(2, narrow.rdd.getNumPartitions())).bit_length() - 1
    parts = written(narrow.mapInArrow(lambda it: _numbered(it, block_tokens, bits), f"{LETTER}, doc_ids array<{id_type}>"), "address")
    dictionary = _only(parts, HASHES, DICTIONARY)
    vocabulary = written(_sent(dictionary, _merged, 1 << bits))
    sums = sorted(_only(vocabulary, HASHES, STATS).select("to", "origin", "x", "y", "z", "w").collect())
    offsets = dict(zip([r.to for r in sums], np.cumsum([0, *(r.origin for r in sums)]).tolist()))
    words, tokens, known, once, twice = (int(sum(r[c] for r in sums)) for c in ("origin", "x", "y", "z", "w"))
    placed = written(_sent(dictionary.unionByName(_only(vocabulary, HASHES, VOCABULARY)), lambda it: _placed(it, offsets), 1 << bits))
    discard(vocabulary)
    discard(parts, f"address={HASHES}")
    release(spark)
    model = Model(tokens, known, min(0.95, max(0.05, once / max(1, once + 2 * twice))))
    ranges = max(1, -(-words // RANGE))
    buckets = min(MOST_BUCKETS, max(1, -(-tokens // bucket_tokens)))
    near = min(NEAR_BITS, (SPREAD * words // buckets).bit_length())
    texts = parts.filter((F.col("address") == BLOCK) & F.col("kind").isin(TEXTS, LOCALS)).select(*Letters.names, "doc_ids")
    blocks = _only(parts, BLOCK, LOCALS).select("to").distinct().count()
    at_blocks = texts.unionByName(_only(placed, BLOCK, IDS), allowMissingColumns=True)
    sent = written(_sent(at_blocks, lambda it: _paired(it, buckets, near, piece_tokens), blocks))
    release(spark)
    pairs = _only(sent, BUCKET, PAIRS)
    seated, totals = gibbs(spark, pairs, _only(placed, WORDS, COUNTS), model, buckets, ranges)
    kept = SWEEPS - BURN
    states = written(_sent(totals.unionByName(_only(sent, WORDS, ASKED)), lambda it: _states(it, kept), ranges))
    answers = written(_sent(pairs.unionByName(seated), lambda it: _answered(it, kept), buckets))
    discard(sent)
    release(spark)
    told = _only(states, BLOCK, STATES).unionByName(_only(answers, BLOCK, ANSWERS))
    scored = _sent(
        at_blocks.unionByName(told, allowMissingColumns=True), lambda it: _scored(it, model, buckets, near, piece_tokens), blocks,
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op5_score(docs: DataFrame) -> DataFrame:
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return score_texts(docs, held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )

"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint: ASCII-lowered words, shingles of ``SHINGLE`` words joined by one space (fewer words:
the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each shingle, repeats included;
a bit is 1 if it is set in over half of the hashes.

Search: the 64 bits are three segments of 22, 21 and 21 bits. A binary Golay code word lies within
3 bits of every 23-bit word, and ``fuzzy`` gives for a segment the at most six code words that
some word within 1 bit of it decodes to: two segments that differ in at most 2 bits share one of
them. At most 4 differing bits leave two cases, and every key below is shared in one of them:

* a segment is equal: then one of the other two differs in at most 2 bits. Key: the equal segment
  and a code word of the other (6 ordered pairs of segments).
* all three differ: then two differ in exactly 1 bit and the third in at most 2. Key: an equal half
  of each of the first two and a code word of the third (3 choices of the third, 4 of the halves).

Candidates share a key and are verified by counting differing bits. Links are only emitted as a
spanning forest of each bucket. A bucket larger than ``BUCKET`` is not compared inside: its members
are linked exactly through midpoints instead (two fingerprints within 4 bits have a common word
within 2 bits of both, and whoever shares such a word is within 4 bits), 2,081 keys for each.

Defined results: null texts count as empty; equal fingerprints are always linked; documents with a
null id take part, and a component without any id has a null component id; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.common import written
from rewardframe.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
#: XXH64 seed of the shingles.
HASH_SEED = 42
#: Fingerprints of one bucket that are compared with each other.
BUCKET = 2048
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a text given as UTF-8."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    starts, ends = starts[: n - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), 8192):
        spans = zip(starts[i : i + 8192].tolist(), ends[i : i + 8192].tolist())
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        got = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(got.view(np.int64), pa.int64())],
            names=["doc_id", "text_key", "fp"],
        )


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the 64 bits as a signed long) of every row."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, text_key long, fp long")


@lru_cache(maxsize=1)
def _error_patterns() -> np.ndarray:
    """For each of the 2,048 syndromes, up to six error patterns of weight 4 or less: the one of
    weight 3 or less, repeated, and, if that has weight 3, the five of weight 4."""

    def remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        return word

    single = [remainder(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            known = found[syndrome]
            if weight < 4 or known[0].bit_count() == 3:
                known.append(sum(1 << b for b in bits))
    return np.array([x + x[:1] * (6 - len(x)) for x in found], dtype=np.int64)


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and lower 11 bits of a 23-bit word (their xor is the word's)."""
    upper = np.arange(4096, dtype=np.int64) << 11
    for shift in range(11, -1, -1):
        upper = np.where(upper >> (shift + 11) & 1, upper ^ (GENERATOR << shift), upper)
    return upper, np.arange(2048, dtype=np.int64)


def fuzzy(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the code words of a segment, six columns, repeats where there are
    fewer."""
    upper, lower = _syndromes()
    errors = _error_patterns()[upper[segment >> 11] ^ lower[segment & 2047]]
    return (segment[:, None] ^ errors) >> 11


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint (uint64), a row for each; see the module's text."""
    words = fps.astype(np.uint64)
    segs = [((words >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    codes = [fuzzy(s) for s in segs]
    halves = []
    for s, (_, size) in zip(segs, SEGMENTS):
        low = size // 2
        halves.append(((s & ((1 << low) - 1)) << 1, (s >> low) << 1 | 1))
    keys, kind = [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                kind += 1
                keys.append((segs[i][:, None] << 12 | codes[j]) << 6 | kind)
    for third in range(3):
        a, b = (x for x in range(3) if x != third)
        kind += 1
        for ha in halves[a]:
            for hb in halves[b]:
                keys.append(((ha << 13 | hb)[:, None] << 12 | codes[third]) << 6 | kind)
    return np.concatenate(keys, axis=1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.asarray(batch.column("fp"), dtype=np.int64)
        for i in range(0, len(fps), 2048):
            part = fps[i : i + 2048]
            keys = np.sort(bucket_keys(part.view(np.uint64)), axis=1)
            new = np.ones(keys.shape, dtype=bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[new]), pa.array(np.repeat(part, new.sum(axis=1)))], names=["key", "fp"]
            )


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within MAX_BITS of each other."""
    words = fps.view(np.uint64)
    if len(words) == 2:
        return [(0, 1)] if int(words[0] ^ words[1]).bit_count() <= MAX_BITS else []
    links, left = [], np.arange(len(words))
    while len(left):  # breadth first: each fingerprint is compared once as a centre
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(words[front[0]] ^ words[left]) <= MAX_BITS
            links += [(int(front[0]), int(x)) for x in left[near]]
            front, left = np.concatenate((front[1:], left[near])), left[~near]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in; links (a, b) go out, and (a, null) for members of buckets of
    more than ``bucket`` fingerprints."""
    keys = np.empty(0, dtype=np.int64)
    fps = np.empty(0, dtype=np.int64)
    large = None  # the key of a bucket found too large, whose members go out as they come

    def rows(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(edges)
        a: list = []
        b: list = []
        pairs = edges[:-1][sizes == 2]
        if len(pairs):
            near = np.bitwise_count((fps[pairs] ^ fps[pairs + 1]).view(np.uint64)) <= MAX_BITS
            a += fps[pairs[near]].tolist()
            b += fps[pairs[near] + 1].tolist()
        for at, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
            members = fps[at : at + size]
            if size > bucket:
                a += members.tolist()
                b += [None] * len(members)
                continue
            for x, y in _forest(members):
                a.append(int(members[x]))
                b.append(int(members[y]))
        return rows(a, b)

    for batch in batches:
        keys = np.concatenate((keys, np.asarray(batch.column("key"), dtype=np.int64)))
        fps = np.concatenate((fps, np.asarray(batch.column("fp"), dtype=np.int64)))
        if not len(keys):
            continue
        if large is not None:
            n = int(np.searchsorted(keys != large, True))
            if n:
                yield rows(fps[:n].tolist(), [None] * n)
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
        cut = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0
        if cut:
            yield done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        large = None
        if len(keys) > bucket:
            large = keys[0]
            yield rows(fps.tolist(), [None] * len(fps))
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield done(keys, fps)


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    flips = np.array(masks, dtype=np.uint64)
    for batch in batches:
        fps = np.asarray(batch.column("fp"), dtype=np.int64)
        for i in range(0, len(fps), 64):
            part = fps[i : i + 64]
            words = part.view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)))], names=["word", "fp"]
            )


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``fps``: distinct fp. Links a, b that connect all fingerprints within MAX_BITS of each
    other (a spanning forest of each bucket, with repeats)."""
    keyed = fps.mapInArrow(_keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = written(keyed.mapInArrow(lambda it: _bucket_links(it, bucket), "a long, b long").distinct())
    crowded = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp"))
    words = crowded.mapInArrow(_midpoints, "word long, fp long")
    # whoever shares a midpoint is linked to the least of them
    least = words.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = words.join(least, "word").select(F.col("fp").alias("a"), "b").filter("a != b").distinct()
    return found.filter(F.col("b").isNotNull()).unionByName(through)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_key, fp, root (the component's own fingerprint), component_id of every row."""
    marked = written(with_fingerprints(docs, shingle))
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = connected_components(fingerprint_links(groups.select("fp"), bucket))
    roots = written(
        groups.join(links, groups["fp"] == links["node"], "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "first"
        )
    )
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.drop("first").join(least, "root")
    return marked.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component: the smallest doc_id (a null id last); rows that share it are
    told apart by their text's hash, then by the hash of their JSON. Columns as in ``docs``, of any types
    and names."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = written(near_duplicates(docs, shingle).groupBy("root").agg(F.min(rank).alias("k")))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    of_kept = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("row.text") == F.col("kept_key")))
    least = F.min_by("row", F.xxhash64(F.to_json("row")))
    return of_kept.groupBy("kept_id", "kept_key").agg(least.alias("row")).select("row.*")


def op8_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", digits.alias("fingerprint"), "component_id")

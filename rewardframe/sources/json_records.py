"""Records of JSON files that are larger than one split, read by as many tasks as there are splits.

A JSON document has no line structure, but the text source can cut it at every ``}`` and reads such
pieces split by split. Whether a split begins inside a string and how deep it is nested follows from
what stands before it, so the file is read three times, each time by all tasks at once:

1. tally: each split counts its quotes, and its brackets for both cases (begun outside or inside a
   string). Summed up in file order, this gives every split's start.
2. outline: with the start known, each split reports the record lists that it opens, their commas and
   whether they hold anything. This chooses each file's list of records as ``read_json_document`` does.
3. cut: each split gives the records that lie in it whole, and the pieces of those that go across
   its ends (a pass of its own, if a file has several splits); pieces of one record are put together by
   their record's place.

One small row for each split (of about ``spark.sql.files.maxPartitionBytes``) passes the driver at each
of the first two passes; texts never do. A record has to fit in one value (``LIMIT`` bytes); one that does
not fails the job, named by file and byte. Each record is parsed by Spark afterwards; what lies outside
the chosen list is checked for strings and brackets only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record that fit in one VARIANT value.
LIMIT = 1 << 27
#: Bytes looked at together.
CHUNK = 1 << 23
QUOTE, BACKSLASH, COMMA = 34, 92, 44
_STRUCTURE = np.zeros(256, dtype=np.int8)
_STRUCTURE[[ord(c) for c in "[{"]] = 1
_STRUCTURE[[ord(c) for c in "]}"]] = -1
_IS_MARK = _STRUCTURE != 0
_IS_MARK[COMMA] = True
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*+)"\s*:\s*\Z', re.DOTALL)


def quotes_of(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end strings: those after an even number of backslashes."""
    at = np.flatnonzero(data == QUOTE)
    after = at[(at > 0) & (data[np.maximum(at, 1) - 1] == BACKSLASH)]
    if not len(after):
        return at
    slashes = np.flatnonzero(data == BACKSLASH)
    first = slashes[np.concatenate(([True], np.diff(slashes) > 1))]
    run = after - first[np.searchsorted(first, after, "left") - 1]
    return np.setdiff1d(at, after[run % 2 == 1], assume_unique=True)


def marks_of(data: np.ndarray, in_string: bool) -> tuple[np.ndarray, bool]:
    """Places of brackets and commas outside strings; whether the data ends inside one."""
    quotes = quotes_of(data)
    marks = np.flatnonzero(_IS_MARK[data])
    outside = (np.searchsorted(quotes, marks) + in_string) % 2 == 0
    return marks[outside], bool((len(quotes) + in_string) % 2)


@dataclass(frozen=True)
class Start:
    """What is known of a split before it is read: its first byte's place in the file, whether the document
    has begun before, whether the split lies in a string, how deep, the depth of the file's records (0:
    the file is one record), the list of records (split and number in it), whether that is open here,
    the record begun before, and whether the split is a whole file that is one record."""

    offset: int = 0
    begun: bool = False
    in_string: bool = False
    depth: int = 0
    level: int = 0
    chosen: tuple[int, int] | None = None
    active: bool = False
    owner: tuple[int, int] = (0, 0)
    alone: bool = False


@dataclass
class Split:
    """A split's row of the first pass, then of the second."""

    file: str
    block: int
    size: int
    bytes: int
    quotes: int
    out_delta: int
    in_delta: int
    root: int
    start: Start = field(default_factory=Start)


def pieces_of(spark: SparkSession, paths: str | list[str], larger_than: int = -1) -> DataFrame:
    """The files of over ``larger_than`` bytes, cut at every bracket; the others are not opened."""
    files = spark.read.option("lineSep", "}").text(paths).where(F.col("_metadata.file_size") > larger_than)
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, file size and text, some CHUNK bytes at a time; a piece keeps the bracket after it."""
    now: tuple[str, int, int] | None = None
    held: list[bytes] = []
    have = 0
    for batch in batches:
        for *key, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size", "value"))):
            if tuple(key) != now or have >= CHUNK:
                if held:
                    yield *now, b"}".join([*held, b""])
                now, held, have = tuple(key), [], 0
            held.append(value)
            have += len(value) + 1
    if held:
        yield *now, b"}".join([*held, b""])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[tuple[str, int], list[int]] = {}
    for file, block, size, text in _chunks(batches):
        data = np.frombuffer(text, dtype=np.uint8)
        t = tallies.setdefault((file, block), [size, 0, 0, 0, 0, 0])
        deltas = [int(_STRUCTURE[data[marks_of(data, begun)[0]]].sum()) for begun in (False, True)]
        if t[2] % 2:  # what began outside a string is inside one by now
            deltas.reverse()
        if not t[5]:
            t[5] = next(iter(text.lstrip()), 0)
        t[1] += len(text)
        t[2] += len(quotes_of(data))
        t[3] += deltas[0]
        t[4] += deltas[1]
    names = ["file", "block", "size", "bytes", "quotes", "out_delta", "in_delta", "root"]
    rows = [(*k, *v) for k, v in tallies.items()]
    columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(len(names))]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def _fail(file: str, what: str) -> ValueError:
    return ValueError(f"not a JSON document: {file}: {what}")


def _with_starts(splits: list[Split]) -> list[Split]:
    """Splits of one file, in order, with the string and depth that each begins in."""
    out, offset, quotes, depth = [], 0, 0, 0
    root = next((s.root for s in splits if s.root), 0)
    level = {ord("["): 1, ord("{"): 2}.get(root, 0)
    for s in splits:
        begun = any(x.start.begun or x.root for x in out[-1:])
        out.append(replace(s, start=Start(offset, begun, quotes % 2 == 1, depth, level)))
        offset += s.bytes
        depth += s.in_delta if quotes % 2 else s.out_delta
        quotes += s.quotes
    last = splits[-1]
    # the file's last piece has a bracket only if the file ends with one
    depth += offset - last.size
    if offset - last.size not in (0, 1) or quotes % 2 or depth:
        raise _fail(last.file, "strings or brackets are not closed")
    return out


class Scan:
    """One split, read chunk by chunk: its events at the depth of records."""

    def __init__(self, file: str, block: int, size: int, start: Start) -> None:
        self.file, self.block, self.size, self.start = file, block, size, start
        self.offset, self.in_string, self.depth = start.offset, start.in_string, start.depth
        self.lists = 0
        self.closed = start.begun and start.level > 0 and start.depth == 0

    def events(self, text: bytes, keys: list[bytes]) -> tuple[bytes, list[tuple[int, str, bytes | None]]]:
        """The chunk as it is in the file, and (place, kind, key): "open" of a list of records, "other" for
        another value at its depth, "close" and "comma"."""
        if self.offset + len(text) == self.size + 1:
            text = text[:-1]
        self.offset += len(text)
        data = np.frombuffer(text, dtype=np.uint8)
        marks, self.in_string = marks_of(data, self.in_string)
        kinds = data[marks]
        deltas = _STRUCTURE[kinds].astype(np.int64)
        after = self.depth + np.cumsum(deltas)
        before = after - deltas
        level = self.start.level
        wanted = np.flatnonzero(np.minimum(before, after) == level - 1) if level else np.empty(0, dtype=np.int64)
        commas = np.flatnonzero((deltas == 0) & (before == level)) if level else np.empty(0, dtype=np.int64)
        out = []
        for i in np.union1d(wanted[deltas[wanted] != 0], commas).tolist():
            place = int(marks[i])
            if deltas[i] == 0:
                out.append((place, "comma", None))
            elif deltas[i] < 0:
                out.append((place, "close", None))
            elif level == 1:
                out.append((place, "open", b""))
            else:
                name = _KEY.search(text[max(0, place - 256) : place]) if kinds[i] == ord("[") else None
                named = name is not None and name[1] in keys
                out.append((place, "open" if named else "other", name[1] if named else None))
        rest = text
        if level and not self.closed:
            ended = np.flatnonzero((after == 0) & (deltas < 0))
            self.closed = bool(len(ended))
            rest = text[int(marks[ended[0]]) + 1 :] if self.closed else text
        if self.closed and rest.strip():
            raise _fail(self.file, f"more after the document's end before byte {self.offset}")
        self.depth = int(after[-1]) if len(after) else self.depth
        return text, out


def _scans(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], Start]) -> Iterator[tuple[Scan, bytes, bool]]:
    """Each chunk with its split's scan, and whether it is the split's first."""
    scan = None
    for file, block, size, text in _chunks(batches):
        first = scan is None or (scan.file, scan.block) != (file, block)
        if first:
            if (file, block) not in starts:
                raise RuntimeError(f"{file} is split in another way than before (executors came or went); read it again")
            scan = Scan(file, block, size, starts[file, block])
        yield scan, text, first


def _outline(batches: Iterator[pa.RecordBatch], starts: dict, keys: list[bytes]) -> Iterator[pa.RecordBatch]:
    """For each split and each list of records that is open in it: its number in the split (0: open from
    before, with no key), key, commas, whether anything stands in it, whether it is open at the end.
    For values of other kinds only what is open at the end (no key)."""
    rows: list[list] = []
    for scan, text, first in _scans(batches, starts):
        if first:
            # open from before: whether it is a list of records is known when all splits are
            now = [scan.file, scan.block, 0, None, 0, False, scan.depth >= scan.start.level > 0]
            others = [scan.file, scan.block, -1, None, 0, False, False]
            rows += [now, others]
        text, events = scan.events(text, keys)
        begin = 0
        for place, kind, key in events:
            if now[6] and not now[5]:
                now[5] = bool(text[begin:place].strip())
            if kind == "comma":
                now[4] += now[6]
            elif kind == "close":
                now[6] = False
            elif kind == "other":
                now = others
                now[6] = True
            else:
                scan.lists += 1
                now = [scan.file, scan.block, scan.lists, key, 0, False, True]
                rows.append(now)
            begin = place + 1
        if now[6] and not now[5]:
            now[5] = bool(text[begin:].strip())
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["file", "block", "list", "key", "commas", "filled", "open"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _with_lists(splits: list[Split], outline: list, keys: list[bytes], limit: int) -> list[Split]:
    """Splits of one file with the list of records chosen: the first of ``keys`` that has one (of a
    repeated key the last), if it holds anything; else the file is one record."""
    by_block: dict[int, list] = {}
    for r in outline:
        by_block.setdefault(r.block, []).append(r)
    held: dict[tuple[int, int], list] = {}  # list -> key, commas, filled
    now: tuple[int, int] | None = None
    open_at: list[tuple[int, int] | None] = []
    for s in splits:
        open_at.append(now)
        for r in sorted(by_block[s.block], key=lambda r: r.list):
            if r.list > 0:
                held[s.block, r.list] = [bytes(r.key), r.commas, r.filled]
            elif r.list == 0 and now is not None:
                held[now][1] += r.commas
                held[now][2] |= r.filled
        ends = [r.list for r in by_block[s.block] if r.open]
        now = None if not ends or ends[0] < 0 else now if ends[0] == 0 else (s.block, ends[0])
    level = splits[0].start.level
    last = {key: at for at, (key, _, _) in held.items()}
    chosen = next((last[k] for k in ([b""] if level == 1 else keys) if k in last), None)
    if chosen is None or not (held[chosen][1] or held[chosen][2]):
        if level == 1:
            return splits  # an empty list: no records
        if splits[-1].size > limit:
            raise _fail(splits[0].file, f"the document is one record of over {limit} bytes")
        return [replace(s, start=replace(s.start, level=0, active=True, owner=(splits[0].block, 0), alone=len(splits) == 1)) for s in splits]
    out, owner, through = [], (chosen[0], 0), 0
    for s, at in zip(splits, open_at):
        out.append(replace(s, start=replace(s.start, chosen=chosen, active=at == chosen, owner=owner)))
        commas = sum(r.commas for r in by_block[s.block] if (s.block, r.list) == chosen or r.list == 0 and at == chosen)
        goes_on = at == chosen and not commas and any(r.list == 0 and r.open for r in by_block[s.block])
        through = through + s.bytes if goes_on else 0
        if through > limit:
            raise _fail(s.file, f"the record that goes on at byte {s.start.offset} takes over {limit} bytes")
        if commas:
            # records are numbered in the split where they begin; 0 is the one after the opening bracket
            owner = (s.block, commas)
    return out


def _cut(batches: Iterator[pa.RecordBatch], starts: dict, keys: list[bytes], limit: int, across: bool) -> Iterator[pa.RecordBatch]:
    """Records that lie in a split, or (``across``) the pieces of the others, with the split of the piece."""
    names = ["file", "block", "pos", "part", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    have = 0
    pending: list[bytes] = []
    scan: Scan | None = None
    active, whole, owner, number = False, True, (0, 0), 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def take(part: bytes) -> None:
        pending.append(part)
        if sum(map(len, pending)) > limit:
            raise _fail(scan.file, f"the record that ends or goes on at byte {scan.offset} takes over {limit} bytes")

    def give(ended: bool) -> None:
        nonlocal have
        text = b"".join(pending)
        pending.clear()
        if across != (ended and whole):
            have += len(text)
            rows.append((scan.file, *owner, scan.block, text))

    for nxt, text, first in _scans(batches, starts):
        if first:
            if scan is not None and active:
                give(scan.start.alone)
            pending.clear()
            scan = nxt
            active, whole, owner, number = scan.start.active, scan.start.alone, scan.start.owner, 0
        text, events = scan.events(text, keys)
        begin = 0
        for place, kind, _ in events:
            if kind == "open":
                scan.lists += 1
                if (scan.block, scan.lists) == scan.start.chosen:
                    active, whole, owner, begin = True, True, (scan.block, 0), place + 1
            elif kind == "comma" and active:
                take(text[begin:place])
                give(True)
                number += 1
                whole, owner, begin = True, (scan.block, number), place + 1
            elif kind == "close" and active:
                take(text[begin:place])
                give(True)
                active = False
        if active:
            take(text[begin:])
        if have > CHUNK:
            yield batch_of()
            rows, have = [], 0
    if scan is not None and active:
        give(scan.start.alone)
    yield batch_of()


def read_large_documents(pieces: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """Records of the JSON files of ``pieces_of``: src_file, src_block, src_pos (together in file order)
    and raw (the record's text). The files are listed once, for all passes."""
    spark, names = pieces.sparkSession, [k.encode() for k in keys]
    tallied = pieces.mapInArrow(
        _tally, "file string, block long, size long, bytes long, quotes long, out_delta long, in_delta long, root long"
    ).collect()
    files: dict[str, list[Split]] = {}
    for r in sorted(tallied, key=lambda r: (r.file, r.block)):
        files.setdefault(r.file, []).append(Split(**r.asDict()))
    files = {f: _with_starts(splits) for f, splits in files.items()}
    starts = spark.sparkContext.broadcast({(s.file, s.block): s.start for splits in files.values() for s in splits})
    outlined = pieces.mapInArrow(
        lambda it: _outline(it, starts.value, names), "file string, block long, list long, key binary, commas long, filled boolean, open boolean"
    ).collect()
    by_file: dict[str, list] = {}
    for r in outlined:
        by_file.setdefault(r.file, []).append(r)
    files = {f: _with_lists(splits, by_file[f], names, limit) for f, splits in files.items()}
    known = spark.sparkContext.broadcast({(s.file, s.block): s.start for splits in files.values() for s in splits})

    def cut(across: bool) -> DataFrame:
        return pieces.mapInArrow(
            lambda it: _cut(it, known.value, names, limit, across), "file string, block long, pos long, part long, text binary"
        )

    place = [F.col("file").alias("src_file"), F.col("block").alias("src_block"), F.col("pos").alias("src_pos")]
    within = cut(False).select(*place, F.col("text").cast("string").alias("raw"))
    if all(len(splits) == 1 for splits in files.values()):
        return within  # no record goes across the ends of a split
    pieces_text = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"].cast("string"))
    begun_before = cut(True).groupBy("file", "block", "pos").agg(pieces_text.alias("pieces"))
    return within.unionByName(begun_before.select(*place, F.array_join("pieces", "").alias("raw")))

"""Sinks: Parquet, JSON Lines, JSON arrays, explicit format choice, crash-safe replace."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.session import ensure_checkpoint_dir

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8 unescaped, null fields written as null (not dropped)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array: each row's JSON, after the bracket or a comma; then the end."""
    before = "["
    for batch in batches:
        lines = []
        for row in batch.column("value").drop_null().to_pylist():
            lines.append(before + row)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])


def write_json_array(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON arrays (K3): each file of the output is one array of its partition's rows, written line
    by line, so no row count is too many; an empty table gives an empty array. With ``one_file`` all rows
    are one array in one file, in the order of ``df`` (see ``_write_one_array``).
    ``readers.read_json_document`` reads the folder back."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    fs, folder = _fs(df.sparkSession, path)
    if one_file and fs.makeQualified(folder).toUri().getScheme() == "file":
        _write_one_array(rows, path)
        return
    # a null row, which is left out of the arrays, so that there is always a partition to write
    rows = rows.unionByName(df.sparkSession.range(1, numPartitions=1).select(F.lit(None).cast("string").alias("value")))
    rows = rows.coalesce(1) if one_file else rows  # other file systems let one task write a file
    rows.mapInArrow(_array_lines, "value string").write.mode("overwrite").text(path)


#: Bytes that are copied together.
COPY_BYTES = 1 << 23


def _copy_parts(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    """Copy files (part) to their places (at) in the file ``target``; their bytes. A task that runs twice
    writes the same bytes to the same place."""
    for batch in batches:
        copied = []
        for part, at in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist()):
            with open(part, "rb") as source, open(target, "r+b") as out:
                out.seek(at)
                shutil.copyfileobj(source, out, COPY_BYTES)
                copied.append(out.tell() - at)
        yield pa.RecordBatch.from_arrays([pa.array(copied, pa.int64())], names=["copied"])


def _write_one_array(rows: DataFrame, path: str) -> None:
    """JSON texts (value) as one array in one file of a mounted file system, written by as many tasks as
    ``rows`` has partitions: each writes a part beside the path, then copies it to its place in the file,
    which follows from the sizes of the parts before it. The file shows up in the folder when it is whole."""
    spark, base, mark = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    fs, folder = _fs(spark, base)
    _, staged = _fs(spark, f"{base}.parts-{mark}")
    try:
        lines = rows.select(F.concat(F.lit(","), "value").alias("value"))
        lines.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(str(staged))
        parts = [(f.getPath().toUri().getPath(), f.getLen()) for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-")]
        parts.sort(key=lambda p: int(re.search(r"/part-(\d+)-[^/]*$", p[0])[1]))
        places, size = [], 0
        for part, n in parts:
            if n:
                places.append((part, size))
            size += n
        _, whole = _fs(spark, f"{base}.parts-{mark}/_array")
        target = fs.makeQualified(whole).toUri().getPath()
        with open(target, "wb") as out:
            out.truncate(size)
        if places:
            dealt = spark.createDataFrame(places, "part string, at long").repartition(len(places))
            copied = dealt.mapInArrow(lambda it: _copy_parts(it, target), "copied long").agg(F.sum("copied")).first()[0]
            if copied != size:
                raise OSError(f"{copied} of {size} bytes of {base} were written")
        with open(target, "r+b") as out:
            out.write(b"[")  # for the comma before the first row
            out.seek(0, os.SEEK_END)
            out.write(b"]\n")
        fs.delete(folder, True)
        fs.mkdirs(folder)
        _, named = _fs(spark, f"{base}/part-00000-{mark}.json")
        if not fs.rename(whole, named):
            raise OSError(f"could not move {whole} to {named}")
        fs.create(_fs(spark, f"{base}/_SUCCESS")[1]).close()
    finally:
        fs.delete(staged, True)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows (benchmark or evaluation results) as one JSON array in one file (K7). A results
    table has one row per model and benchmark, so one file holds it; larger tables belong in
    ``write_dataset``."""
    write_json_array(results, path, one_file=True)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Explicit output format: ``parquet``, ``jsonl`` or ``json`` (K4)."""
    if fmt == "parquet":
        write_parquet(df, path)
    elif fmt == "jsonl":
        write_jsonl(df, path)
    elif fmt == "json":
        write_json_array(df, path)
    else:
        raise ValueError(f"unsupported output format: {fmt!r}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_path(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace an output that may be the input (K5): write a sibling folder, move the old folder
    aside, move the new one in, then remove the old one.

    Every move is checked. If the new folder cannot be moved in, the old one is moved back and the
    job fails. A crash between the two moves leaves no ``path``, but the complete old and new data
    beside it (``path.old-...`` and ``path.tmp-...``); nothing is removed before the swap is done.
    """
    spark = df.sparkSession
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    write_dataset(df, f"{base}.tmp-{mark}", fmt)
    fs, target = _fs(spark, base)
    _, staged = _fs(spark, f"{base}.tmp-{mark}")
    _, old = _fs(spark, f"{base}.old-{mark}")
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, old):
        raise OSError(f"could not move {base} aside; the new data is in {staged}")
    if not fs.rename(staged, target):
        restored = not replaced or fs.rename(old, target)
        raise OSError(f"could not move {staged} to {base}" + ("" if restored else f"; the old data is in {old}"))
    if replaced:
        fs.delete(old, True)


#: Below a published path: its versions, and pointers (the one with the highest number counts).
VERSIONS, POINTER = "_versions", "_current-"


def current_version(spark: SparkSession, path: str) -> str:
    """The folder that holds a path's data now: that of its newest pointer, or the path itself."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        return path
    names = sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).startswith(POINTER))
    # a pointer's name holds its number and its version's name
    return f"{path.rstrip('/')}/{VERSIONS}/{names[-1].removeprefix(POINTER)}" if names else path


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Replace an output, which may be the input, so that ``readers.read_any`` finds it whole at every
    instant (K5): the rows are written as a new version below the path, then one empty pointer file is
    created, which is one atomic step on any file system, object stores too. Two jobs that publish at
    once do not overwrite each other's version: the one that comes second fails.

    The version before stays for whoever is reading it, until the next time; older ones, and versions that
    a crash left without a pointer, go. What lay at the path itself before its first version goes after
    that is published, so that a plain reader of the folder fails and does not read old rows. Returns the
    new version's folder."""
    spark, base = df.sparkSession, path.rstrip("/")
    before = current_version(spark, base)
    at = before.rsplit("/", 1)[-1] if before != path and before != base else ""
    number = int(at.split("-")[0]) + 1 if at else 1
    name = f"{number:09d}-{uuid.uuid4().hex}"
    write_dataset(df, f"{base}/{VERSIONS}/{name}", fmt)
    if current_version(spark, base) != before:
        raise OSError(f"{base} was published meanwhile; the new data is in {VERSIONS}/{name}")
    fs, claim = _fs(spark, f"{base}/{VERSIONS}/{number:09d}")
    if not fs.createNewFile(claim):  # whoever creates it first has the number
        raise OSError(f"version {number} of {base} is being published by another job; the new data is in {VERSIONS}/{name}")
    _, pointer = _fs(spark, f"{base}/{POINTER}{name}")
    fs.create(pointer, False).close()
    _drop_old(spark, base, {name, at})
    return f"{base}/{VERSIONS}/{name}"


def _drop_old(spark: SparkSession, base: str, keep: set[str]) -> None:
    """Remove what no reader can have begun to read since the version before was published."""
    fs, folder = _fs(spark, base)
    newest = max(keep)
    for f in fs.listStatus(folder):
        n = f.getPath().getName()
        if n.startswith(POINTER):
            if n.removeprefix(POINTER) not in keep:
                fs.delete(f.getPath(), False)
        elif n != VERSIONS:
            fs.delete(f.getPath(), True)  # files from before the first version
    _, versions = _fs(spark, f"{base}/{VERSIONS}")
    for f in fs.listStatus(versions):
        n = f.getPath().getName()
        if n not in keep and n[:9] < newest[:9]:
            fs.delete(f.getPath(), True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp folder). The
    application's scratch folders go when its JVM ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_rf_scratch", None) != base:
        fs, folder = _fs(spark, base)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        spark.sparkContext._rf_scratch = base
    return f"{base}/{name}-{uuid.uuid4().hex}"

"""Helpers shared by the operators: table reading, written intermediate tables, word rules."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.session import ship_package
from rewardframe.sources.sinks import _fs, scratch_dir

#: White space of the word rule: words are runs of anything but these six ASCII characters.
#: ``bytes.split()`` without arguments splits on exactly this set.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes with A-Z lower-cased.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder and read it back: the
    lineage is cut, an executor's loss costs nothing, and the planner knows the table's size (so
    it broadcasts it only when it is below the broadcast threshold). The application's tables go
    when its JVM ends. ``by``: a column of text by whose values the table has folders."""
    path = scratch_dir(df.sparkSession, "table")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a table of ``written`` that a later one supersedes, or one of its folders; frames that read
    it can't run again."""
    fs, folder = _fs(table.sparkSession, f"{table._written_to}/{part}".rstrip("/"))
    fs.delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished steps: it does so when the driver's objects that
    stand for them are collected as garbage, which may come late in a long job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_column: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id has no fold and gets null."""
    return F.crc32(id_column.cast("string").cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number

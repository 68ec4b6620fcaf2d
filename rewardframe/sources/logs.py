"""Evaluator logs as a source (S8): scores of models and benchmarks from folders of log files.

A score stands on a marker line or on the line after it. Log files are read as lines by as many tasks as
their splits make, so the line after a marker may be the first of the next split: each split gives its
marker lines, with the line after each, and its first line, which completes a marker at the end of the
split before. Only these lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardframe.operators.evaluation import BASE_MARKER, PLUS_MARKER, SCORE_TAG

#: Model and benchmark of a log file: the folder it is in, and its name without the suffix.
LOG_PATH = r"([^/]+)/([^/]+?)(?:\.[^./]*)?$"


def _noted(batches: Iterator[pa.RecordBatch], markers: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Of each split: the first line (no marker), and for each marker in a line a row of the line and the
    one after it (null at the split's end)."""
    names = ["file", "block", "pos", "marker", "line", "after"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    now, pos, waiting = None, 0, []
    rows: list[tuple] = []
    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != now:
                rows += [(*w, None) for w in waiting]
                now, pos, waiting = (file, block), 0, []
                rows.append((file, block, -1, None, line, None))
            rows += [(*w, line) for w in waiting]
            waiting = [(file, block, pos, m, line) for m in markers if m in line]
            pos += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        rows = []
    rows = [(*w, None) for w in waiting]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def marked_lines(spark: SparkSession, path: str, markers: Sequence[str]) -> DataFrame:
    """file, block, pos, marker, line, after: the lines of text files that hold a marker, each with the line
    after it in the file (null if it is the last one)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    noted = lines.mapInArrow(lambda it: _noted(it, markers), "file string, block long, pos long, marker string, line string, after string")
    # a marker at a split's end goes on in the first line of the file's next split: two rows of each split
    first = F.when(F.col("marker").isNull(), F.struct("line"))
    ahead = Window.partitionBy("file").orderBy("block", F.col("marker").isNotNull(), "pos").rowsBetween(1, Window.unboundedFollowing)
    at_ends = noted.where(F.col("after").isNull()).withColumn("next", F.first(first, ignorenulls=True).over(ahead))
    columns = ["file", "block", "pos", "marker", "line"]
    whole = noted.where(F.col("after").isNotNull()).select(*columns, "after")
    return whole.unionByName(at_ends.where(F.col("marker").isNotNull()).select(*columns, F.col("next.line").alias("after")))


def read_eval_logs(spark: SparkSession, path: str, exit_codes: DataFrame | None = None, pattern: str = LOG_PATH) -> DataFrame:
    """model, benchmark, base_score, plus_score of the log files below ``path``, whose names give model and
    benchmark (the two groups of ``pattern``; files of one model and benchmark are read in name order).
    ``exit_codes``: model, benchmark, exit_code; a code other than 0 gives ``Error``. A log without a
    score gives ``N/A``; so does a run of ``exit_codes`` without a log."""
    named = [F.regexp_extract("file", pattern, i).alias(n) for i, n in ((1, "model"), (2, "benchmark"))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    runs = files.select(F.col("path").alias("file")).select(*named).distinct()
    # the marker line and the one after it, whichever first holds a score
    held = F.filter(F.array("line", "after"), lambda s: F.coalesce(F.instr(F.lower(s), SCORE_TAG) > 0, F.lit(False)))
    found = marked_lines(spark, path, [BASE_MARKER, PLUS_MARKER]).select(*named, "file", "block", "pos", "marker", F.try_element_at(held, F.lit(1)).alias("held"))
    fields = F.split(F.regexp_replace("first.held", r"^[ \t]+", ""), r"[ \t]+")
    score = F.nullif(F.try_element_at(fields, F.lit(2)), F.lit(""))
    first = found.where(F.col("held").isNotNull()).groupBy("model", "benchmark", "marker").agg(F.min(F.struct("file", "block", "pos", "held")).alias("first"))
    scores = first.select("model", "benchmark", "marker", score.alias("score")).groupBy("model", "benchmark").agg(
        *(F.max(F.when(F.col("marker") == m, F.col("score"))).alias(n) for m, n in ((BASE_MARKER, "base"), (PLUS_MARKER, "plus")))
    )
    codes = runs.withColumn("exit_code", F.lit(0))
    if exit_codes is not None:
        given = exit_codes.select(F.col("model").cast("string"), F.col("benchmark").cast("string"), F.col("exit_code").cast("int"))
        codes = runs.join(given, ["model", "benchmark"], "full")
    failed = F.coalesce(F.col("exit_code"), F.lit(0)) != 0
    return codes.join(scores, ["model", "benchmark"], "left").select(
        "model", "benchmark",
        *(F.when(failed, "Error").otherwise(F.coalesce(n, F.lit("N/A"))).alias(f"{n}_score") for n in ("base", "plus")),
    )

"""Structured Streaming: score rows as they arrive (ST1) and keep running manager totals (ST2).

Scoring is stateless (append mode, the same column arithmetic as batch); the totals are a
global aggregation whose state is a handful of counters, checkpointed under the shared
checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.operators.reward import RewardConfig, manager_stats, shape_columns
from rewardframe.sources.sinks import scratch_dir


def score_stream(flags: DataFrame, cfg: RewardConfig = RewardConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Reward columns for a streaming frame of per-response flags and counts (see
    ``reward.shape_columns`` for the inputs). Works on batch frames too."""
    return flags.select(*keep, *shape_columns(cfg))


def stats_stream(rewards: DataFrame) -> DataFrame:
    """Running totals and rates over a stream of reward rows (complete output mode)."""
    return manager_stats(rewards)


def run_available(query_df: DataFrame, out_dir: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now, then stop: append rows to Parquet, or (complete mode)
    write each micro-batch's result to a folder of its own, ``epoch=N``. A batch that is repeated
    after a crash writes its own folder again and touches no other; ``latest_result`` reads the
    last complete one."""
    writer = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", out_dir).start()
    else:
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch:09d}")

        q = writer.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()


def latest_result(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last complete result of a complete-mode stream (its folder holds a success mark)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/epoch=*/_SUCCESS"))
    if not len(done):
        raise FileNotFoundError(f"no complete result in {out_dir}")
    return spark.read.parquet(max(str(d.getPath().getParent()) for d in done))


def stream_from_files(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream with the schema taken from the data already there. A single-file path is
    streamed as its folder filtered to that file name (the file source watches folders)."""
    schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith("." + fmt):
        folder, name = path.rstrip("/").rsplit("/", 1)
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getFileStatus(fs_path).isFile():
            return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def scratch_for(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_dir(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def event_flags(events: DataFrame) -> DataFrame:
    """Per-event response flags and outcome counts used by the streaming queries' fixture:
    every event is one scored response with two tests."""
    e = F.col("event_type")
    passed = F.when(e == "view", 2).when(e == "click", 1).otherwise(0)
    return events.select(
        F.col("event_id").alias("sample_id"),
        (e != "error").alias("has_code"),
        ((e != "error") & (F.col("event_id") % 7 != 3)).alias("syntax_valid"),
        ((e != "error") & (F.col("event_id") % 7 != 3) & (F.col("event_id") % 11 != 5)).alias("compile_valid"),
        F.lit(2).alias("n_tests"),
        F.length("props").alias("code_length"),
        passed.alias("passed_n"),
        F.lit(0).alias("timeouts_n"),
        (F.lit(2) - passed).alias("runtime_errors_n"),
        F.lit(2).alias("outcomes_n"),
        F.lit(0.0).alias("execution_time"),
    )

"""End-to-end dataset jobs: the command-line flows of the reference as Spark jobs.

Each job reads with the library's readers, composes operators, and writes with the sinks.
Where one intermediate feeds several outputs it is checkpointed to the shared checkpoint folder
(``spark.checkpoint.dir``), which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.functions.text import truthy_first
from rewardframe.operators import convert as CV
from rewardframe.operators import sampling as SM
from rewardframe.operators import verify as V
from rewardframe.session import materialize
from rewardframe.sources import readers as RD
from rewardframe.sources import sinks as SK


def verify_job(
    samples: DataFrame,
    out_dir: str,
    outcomes: DataFrame | None = None,
    runner: Callable | None = None,
    n_runs: int = V.DEFAULT_N_RUNS,
    keep_status: Sequence[str] = ("pass",),
    id_col: str = "sample_id",
    order_col: str | None = None,
    num_partitions: int | None = None,
    log_path: str | None = None,
) -> DataFrame:
    """Verify a dataset: outcomes (given, with whatever runs they hold, or produced by ``runner``
    over an execution plan of ``n_runs`` runs) -> per-sample results -> kept samples (JSON Lines),
    results (Parquet), report (JSON).

    Samples without an id get their position as id first (``order_col`` orders them), so a
    missing id never matches every other missing id. With ``log_path`` the outcomes are kept there as
    tests end, and a job that is run again executes only what is missing. Returns the status counts table.
    """
    if order_col is not None:
        samples = SM.with_position_id(samples, id_col, order_col)
    if outcomes is None:
        if runner is None:
            raise ValueError("give outcomes or a runner")
        if log_path is None:
            raw = V.run_executions(V.plan_executions(samples, n_runs, id_col=id_col), runner, id_col, num_partitions)
        else:
            raw = V.resume_samples(samples, runner, log_path, n_runs, id_col)
        outcomes = V.classify_outcomes(raw, [id_col, "run", "test_idx"])
    # the outcomes are read once; the results, by four outputs
    results = materialize(V.verify_results(samples, outcomes, id_col=id_col))
    SK.write_jsonl(V.kept_samples(samples, results, keep_status, id_col), f"{out_dir}/kept")
    V.write_verify_report(V.verify_report(results, keep_status), results, out_dir)
    return V.status_counts(results)


def convert_job(
    spark,
    input_path: str,
    output_path: str,
    fmt: str = "parquet",
    data_source: str = CV.DEFAULT_DATA_SOURCE,
    ability: str = CV.DEFAULT_ABILITY,
    split: str = CV.DEFAULT_SPLIT,
    input_format: str | None = None,
    rejects_path: str | None = None,
) -> DataFrame:
    """Any input (JSONL / JSON / Parquet, one file or a folder) -> training records in file order
    -> ``fmt`` output. Records that cannot be converted go to ``rejects_path`` with a reason, if
    it is given. Returns the conversion report with the number of rejects."""
    kind = input_format or input_path.rstrip("/").rsplit(".", 1)[-1].lower()
    rows = SM.index_in_file_order(RD.read_any(spark, input_path, kind, origin=True), "_row")
    if kind == "parquet":
        rows, rejects = CV.convertible_rows(rows, ["_row"])
        records = CV.training_records(rows, "_row", data_source, ability, split)
    else:
        rows, rejects = CV.convertible(rows)
        records = CV.records_from_variant(rows, "_row", data_source=data_source, ability=ability, split=split)
    SK.write_dataset(records, output_path, fmt)
    if rejects_path is not None:
        SK.write_jsonl(rejects, rejects_path)
    written = spark.read.parquet(output_path) if fmt == "parquet" else spark.read.schema(records.schema).json(output_path, multiLine=fmt == "json")
    return CV.conversion_report(written).withColumn("rejected", rejects.agg(F.count(F.lit(1))).scalar())


def split_job(df: DataFrame, id_col: str, train_path: str, val_path: str, train_ratio: float = 0.95,
              seed: int = SM.DEFAULT_SEED, fmt: str = "jsonl") -> None:
    """Exact seeded split into two outputs, each written in the shuffled order."""
    train, val = SM.split_exact(df, id_col, train_ratio, seed, ordered=True)
    SK.write_dataset(train, train_path, fmt)
    SK.write_dataset(val, val_path, fmt)


def sft_job(
    df: DataFrame,
    instruction_cols: str | Sequence[str],
    output_cols: str | Sequence[str],
    id_col: str,
    out_path: str,
    max_samples: int | None = None,
    max_total_chars: int | None = 3000,
    min_output_chars: int | None = None,
    system_prompt: str | None = CV.DEFAULT_SYSTEM_PROMPT,
    seed: int = SM.DEFAULT_SEED,
    single_counter: bool = False,
) -> DataFrame:
    """SFT preparation: the first truthy of the instruction and output columns, seeded order,
    first-failing-rule funnel, chat messages, JSON Lines output in the shuffled order; the scan
    stops at ``max_samples`` accepted rows if that is given. Returns the funnel counts."""
    names = [[c] if isinstance(c, str) else list(c) for c in (instruction_cols, output_cols)]
    texts = df.withColumns({"_instruction": truthy_first(*names[0]), "_output": truthy_first(*names[1])})
    reason = SM.sft_reason("_instruction", "_output", max_total_chars, min_output_chars, single_counter)
    accepted, funnel = SM.sample_accepted(texts.withColumn("reason", reason), "reason", id_col, max_samples, seed, ordered=True)
    SK.write_jsonl(accepted.select(CV.sft_messages("_instruction", "_output", system_prompt).alias("messages")), out_path)
    return funnel


def token_filter_job(
    df: DataFrame, col: str, max_tokens: int, out_path: str, counter=None, replace: bool = False, publish: bool = False
) -> DataFrame:
    """Keep rows whose sample (messages, or a string taken as one user message) renders to at
    most ``max_tokens`` tokens; the length is not kept. ``replace=True`` swaps the output in with
    write-then-rename (safe when the output path is the input path); ``publish=True`` makes it a new
    version of the path, which ``readers.read_any`` finds whole at every instant. Returns the output, read
    afresh."""
    from rewardframe.functions.tokens import count_tokens

    kept = CV.within_tokens(df, col, max_tokens, counter or count_tokens, "_n_tokens").drop("_n_tokens")
    if publish:
        SK.publish(kept, out_path, "parquet")
    elif replace:
        SK.replace_path(kept, out_path, "parquet")
    else:
        SK.write_parquet(kept, out_path)
    return RD.read_any(df.sparkSession, out_path, "parquet")

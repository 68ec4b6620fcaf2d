"""Dataset verification: execution plan, outcome classification, per-sample status, reports.

Shapes
------
samples   : one row per sample, ``id_col`` plus either ``has_solution``/``n_tests`` or
            ``solution``/``tests`` (array<string>)
outcomes  : one row per executed (sample, run, test): ``id_col, run, test_idx, status``
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.functions.text import pct1, py_strip
from rewardframe.sources.sinks import _fs


class Outcome(NamedTuple):
    """What a class of outcomes says where the output is empty, and its error type."""

    message: str
    error_type: str | None


# Fixed values that must equal the reference's for equal results.
SENTINEL_PREFIX = "__TESTS_COMPLETED__:"
SCRIPT_HEADER = "# -*- coding: utf-8 -*-"
# outcome classes in the order they are tested
OUTCOME_BLOCKED = Outcome("Security violation", "SECURITY_VIOLATION")
OUTCOME_TIMEOUT = Outcome("Timeout", "TIMEOUT")
OUTCOME_INCOMPLETE = Outcome("Program exited before tests completed", "INCOMPLETE_TEST_RUN")
OUTCOME_SUCCESS = Outcome("All tests passed", None)
OUTCOME_ASSERTION = Outcome("Test failed", "ASSERTION_ERROR")  # output mentions AssertionError
OUTCOME_SYNTAX = Outcome("Syntax error", "SYNTAX_ERROR")  # output mentions SyntaxError
OUTCOME_NO_SANDBOX = Outcome("", "FIREJAIL_NOT_AVAILABLE")  # output mentions FIREJAIL_NOT_AVAILABLE
OUTCOME_OTHER = Outcome("Execution failed", "RUNTIME_ERROR")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
STABLE_SPREAD = 0.1  # max - min of run pass rates must stay below this
DEFAULT_N_RUNS = 4
VERIFY_TIMEOUT_S = 8.0
# ---- our own ----
RUNNER_ERROR = "RUNNER_ERROR"  # error type a runner reports when it could not verify a sample


def _sample_flags(samples: DataFrame) -> DataFrame:
    """Add ``has_solution``/``n_tests`` when the samples carry raw ``solution``/``tests``."""
    cols = set(samples.columns)
    if "has_solution" not in cols:
        # any text but the empty one is run, white space too
        present = F.coalesce(F.col("solution") != "", F.lit(False)) if "solution" in cols else F.lit(False)
        samples = samples.withColumn("has_solution", present)
    if "n_tests" not in cols:
        samples = samples.withColumn("n_tests", F.coalesce(F.size("tests"), F.lit(0)) if "tests" in cols else F.lit(0))
    return samples


# ---------------------------------------------------------------- execution plan

def sentinel_for(id_col: Column, run: Column, test_idx: Column) -> Column:
    """Repeatable sentinel per (sample, run, test)."""
    key = F.concat_ws(":", id_col.cast("string"), run.cast("string"), test_idx.cast("string"))
    return F.concat(F.lit(SENTINEL_PREFIX), F.sha2(key, 256))


def build_script(code: Column, test: Column, sentinel: Column) -> Column:
    """Header, code, blank line, test, blank line, print(sentinel) — whole lines, no dedent."""
    return F.concat(
        F.lit(SCRIPT_HEADER + "\n"), code, F.lit("\n\n"), test, F.lit("\n\nprint('"), sentinel, F.lit("')\n")
    )


def plan_executions(
    samples: DataFrame,
    n_runs: int = DEFAULT_N_RUNS,
    id_col: str = "sample_id",
    code_col: str = "solution",
    tests_col: str = "tests",
    timeout_s: float = VERIFY_TIMEOUT_S,
) -> DataFrame:
    """One row per (sample, run, test) for samples that have code and tests.

    Carries only the key, the script and the time limit — never the prompt — so the fan-out
    (rows x tests x runs) stays narrow. Explode is a narrow operator: no shuffle here.
    """
    runnable = samples.where((F.col(code_col) != "") & (F.size(tests_col) > 0))
    return _plan_rows(runnable, F.sequence(F.lit(0), F.lit(n_runs - 1)), F.lit(0), id_col, code_col, tests_col, timeout_s)


def _plan_rows(
    samples: DataFrame, runs: Column, first_test: Column, id_col: str, code_col: str, tests_col: str, timeout_s: float, keep: Sequence[str] = ()
) -> DataFrame:
    """A row for each of the samples' runs and tests, the first of which has the number ``first_test``."""
    fan = samples.select(
        F.col(id_col), F.col(code_col), *keep, runs.alias("_runs"), first_test.alias("_first"), F.posexplode(tests_col).alias("test_idx", "test")
    ).select(
        id_col, code_col, *keep, (F.col("_first") + F.col("test_idx")).alias("test_idx"), "test", F.explode("_runs").alias("run")
    )
    sentinel = sentinel_for(F.col(id_col), F.col("run"), F.col("test_idx"))
    return fan.select(
        F.col(id_col),
        F.col("run").cast("bigint").alias("run"),
        F.col("test_idx").cast("bigint").alias("test_idx"),
        sentinel.alias("sentinel"),
        build_script(F.col(code_col), F.col("test"), sentinel).alias("script"),
        F.lit(float(timeout_s)).alias("timeout_s"),
        *keep,
    )


OUTCOME_SCHEMA = (
    "ok boolean, returncode int, stdout string, stderr string, timed_out boolean, "
    "blocked boolean, error_type string"
)


def run_executions(plan: DataFrame, runner, id_col: str = "sample_id", num_partitions: int | None = None) -> DataFrame:
    """Run a caller-supplied ``mapInPandas`` runner over the plan.

    The runner maps pandas batches of plan rows to batches with the plan's keys (``id_col``, run,
    test_idx, sentinel) plus the process-outcome columns of ``OUTCOME_SCHEMA``. Rows are always
    spread by a hash of the full key, so one heavy sample never holds one task.
    """
    keys = [id_col, "run", "test_idx"]
    spread = plan.repartition(num_partitions, *keys) if num_partitions else plan.repartition(*keys)
    kinds = {f.name: f.simpleString() for f in plan.schema.fields}
    return spread.mapInPandas(runner, ", ".join([*(kinds[c] for c in (*keys, "sentinel")), OUTCOME_SCHEMA]))


#: Executions of one task, whose outcomes are committed together.
COMMIT_ROWS = 500
#: Runs and tests of one id that go to the same task.
CHUNK = {"run": 8, "test_idx": 4}
AT = ["_id", "_run", "_test_idx"]
#: What, with the id, tells one execution from another.
LOG_KEY = ["run", "test_idx", "script_hash"]


def logged_attempts(spark: SparkSession, log_path: str, id_col: str = "sample_id") -> DataFrame | None:
    """Outcomes in an execution log, one for each script and its key (of attempts that were repeated any
    one); None if there is no log yet."""
    fs, folder = _fs(spark, log_path)
    if not fs.exists(folder) or not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(folder)):
        return None
    return spark.read.parquet(log_path).dropDuplicates([id_col, "run", "test_idx", "script_hash"])


def resume_executions(
    plan: DataFrame, runner, log_path: str, id_col: str = "sample_id", commit_rows: int = COMMIT_ROWS
) -> DataFrame:
    """Run what the log at ``log_path`` does not hold yet, add it to the log, and return the plan's
    outcomes (E3). A script's outcome counts for its (id, run, test) as long as the script is the same.

    Tasks of about ``commit_rows`` executions commit their outcomes one by one, as they end (file output
    committer, algorithm 2): if the job fails or is stopped, what committed tasks have done stays, and
    the next call plans only the rest. A task that a lost executor ran is run again as a whole; if both
    attempts come to be committed, the log's reader takes one.

    Scripts are shuffled once, to the task that runs them, where the log's keys (no scripts) meet them. A
    few runs and tests of one id go together (``CHUNK``)."""
    hashed = plan.withColumn("script_hash", F.sha2("script", 256))

    def deal(before: DataFrame | None, tasks: int) -> DataFrame:
        rows = hashed.select("*", *_chunk(id_col)).repartition(tasks, *AT)
        met = rows if before is None else _with_logged(rows, before, tasks, id_col)
        return (met if before is None else _unlogged(met)).drop(*AT)

    return _resumed(hashed, deal, runner, log_path, id_col, commit_rows)


def resume_samples(
    samples: DataFrame,
    runner,
    log_path: str,
    n_runs: int = DEFAULT_N_RUNS,
    id_col: str = "sample_id",
    code_col: str = "solution",
    tests_col: str = "tests",
    timeout_s: float = VERIFY_TIMEOUT_S,
    commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """``resume_executions`` of ``plan_executions``, with the same scripts and log. Code is shuffled once for
    each ``CHUNK`` of a sample's runs and tests, and the scripts are built in the task that runs them."""
    runnable = samples.where((F.col(code_col) != "") & (F.size(tests_col) > 0))
    of_run, of_test = CHUNK["run"], CHUNK["test_idx"]
    chunks = runnable.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit((n_runs - 1) // of_run).cast("bigint"))).alias("_run")
    ).select(
        id_col, code_col, tests_col, "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.size(tests_col) - 1) / of_test))).alias("_test_idx")
    ).select(
        id_col, code_col, F.slice(tests_col, (F.col("_test_idx") * of_test + 1).cast("int"), F.lit(of_test)).alias(tests_col),
        F.col(id_col).alias("_id"), "_run", "_test_idx",
    )

    def planned(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        first_run = F.col("_run") * of_run
        runs = F.sequence(first_run, F.least(first_run + (of_run - 1), F.lit(n_runs - 1).cast("bigint")))
        plan = _plan_rows(rows, runs, F.col("_test_idx") * of_test, id_col, code_col, tests_col, timeout_s, keep)
        return plan.withColumn("script_hash", F.sha2("script", 256))

    def deal(before: DataFrame | None, tasks: int) -> DataFrame:
        rows = chunks.repartition(tasks, *AT)
        return planned(rows) if before is None else _unlogged(planned(_with_logged(rows, before, tasks, id_col), ["_logged"]))

    return _resumed(planned(chunks), deal, runner, log_path, id_col, commit_rows)


def _chunk(id_col: str) -> list[Column]:
    """The columns ``AT`` of a row of a plan or a log."""
    return [F.col(id_col).alias("_id"), *(F.floor(F.col(c) / size).alias(f"_{c}") for c, size in CHUNK.items())]


def _with_logged(rows: DataFrame, before: DataFrame, tasks: int, id_col: str) -> DataFrame:
    """Rows dealt by ``AT`` with what the log holds of their chunk (``_logged``). The join is built from the
    log, so that code and scripts are not sorted for it."""
    held = before.select(*_chunk(id_col), F.struct(*LOG_KEY).alias("key")).repartition(tasks, *AT)
    return rows.join(held.groupBy(*AT).agg(F.collect_list("key").alias("_logged")).hint("shuffle_hash"), AT, "left")


def _unlogged(plan: DataFrame) -> DataFrame:
    """Rows of a plan that are not in ``_logged``; a null script is in no log."""
    there = F.col("_logged").isNotNull() & F.col("script_hash").isNotNull() & F.array_contains("_logged", F.struct(*LOG_KEY))
    return plan.where(~there).drop("_logged")


def _resumed(hashed: DataFrame, deal: Callable, runner, log_path: str, id_col: str, commit_rows: int) -> DataFrame:
    """Run the rows of a plan that ``deal(log, number of tasks)`` gives, log them, and return the plan's outcomes."""
    spark, keys = hashed.sparkSession, [id_col, *LOG_KEY]
    before = logged_attempts(spark, log_path, id_col)
    n = (hashed if before is None else hashed.join(before.select(*keys), keys, "left_anti")).count()
    if n:
        kinds = {f.name: f.simpleString() for f in hashed.schema.fields}
        ran = deal(before, max(1, -(-n // commit_rows))).mapInPandas(
            lambda batches: _with_hashes(runner, batches, [id_col, "run", "test_idx"]),
            ", ".join([*(kinds[c] for c in (*keys, "sentinel")), OUTCOME_SCHEMA]),
        )
        ran.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(log_path)
    after = logged_attempts(spark, log_path, id_col)
    if after is None:  # an empty plan
        return hashed.select(*keys, "sentinel", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in OUTCOME_SCHEMA.split(", "))))
    return after.join(hashed.select(*keys), keys, "left_semi")


def _with_hashes(runner, batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runner's batches, with the hash of the script of each row."""
    hashes: dict[tuple, str] = {}

    def noted() -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes.update(zip(zip(*(batch[k] for k in keys)), batch["script_hash"]))
            yield batch

    for out in runner(noted()):
        yield out.assign(script_hash=[hashes[k] for k in zip(*(out[k] for k in keys))])


# ---------------------------------------------------------------- outcome classification

def strip_sentinel(output: Column, sentinel: Column) -> Column:
    """Drop lines equal to the sentinel (after strip), rejoin, strip. A line ends where Python's
    ``splitlines`` ends it."""
    lines = F.split(F.coalesce(output, F.lit("")), LINE_END)
    kept = F.filter(lines, lambda line: py_strip(line) != sentinel)
    return py_strip(F.array_join(kept, "\n"))


def classify_outcome(
    output: Column,
    sentinel: Column,
    returncode: Column,
    timed_out: Column,
    blocked: Column,
    given_type: Column | None = None,
) -> Column:
    """Process outcome -> struct(status, message, error_type); first matching rule wins."""
    given = F.nullif(given_type, F.lit("")) if given_type is not None else F.lit(None).cast("string")
    out = F.coalesce(output, F.lit(""))
    cleaned = strip_sentinel(out, sentinel)
    saw_sentinel = F.instr(out, sentinel) > 0
    rc0 = F.coalesce(returncode == 0, F.lit(False))

    def res(status: str, message: Column, etype: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), message.alias("message"), etype.alias("error_type"))

    def msg_or(text: str) -> Column:
        return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(text))

    none = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(blocked, F.lit(False)), res("error", msg_or(OUTCOME_BLOCKED.message), F.coalesce(given, F.lit(OUTCOME_BLOCKED.error_type))))
        .when(F.coalesce(timed_out, F.lit(False)), res("error", F.lit(OUTCOME_TIMEOUT.message), F.lit(OUTCOME_TIMEOUT.error_type)))
        .when(rc0 & ~saw_sentinel, res("error", F.lit(OUTCOME_INCOMPLETE.message), F.lit(OUTCOME_INCOMPLETE.error_type)))
        .when(rc0 & saw_sentinel, res("success", F.lit(OUTCOME_SUCCESS.message), none))
        .when(F.instr(out, "AssertionError") > 0, res("error", msg_or(OUTCOME_ASSERTION.message), F.lit(OUTCOME_ASSERTION.error_type)))
        .when(F.instr(out, "SyntaxError") > 0, res("error", msg_or(OUTCOME_SYNTAX.message), F.lit(OUTCOME_SYNTAX.error_type)))
        .when(F.instr(out, "FIREJAIL_NOT_AVAILABLE") > 0, res("error", cleaned, F.lit(OUTCOME_NO_SANDBOX.error_type)))
        .otherwise(res("error", msg_or(OUTCOME_OTHER.message), F.coalesce(given, F.lit(OUTCOME_OTHER.error_type))))
    )


def classify_outcomes(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Classify a table of process outcomes (``output`` = stdout + stderr, or given directly)."""
    cols = set(raw.columns)
    output = F.col("output") if "output" in cols else F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    given = F.col("error_type") if "error_type" in cols else None
    r = classify_outcome(output, F.col("sentinel"), F.col("returncode"), F.col("timed_out"), F.col("blocked"), given)
    return raw.select(*keep, r.alias("r")).select(*keep, "r.status", "r.message", "r.error_type")


# ---------------------------------------------------------------- per-sample status

def run_pass_counts(outcomes: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Successes of each run of a sample, in run order, over the runs that the outcomes hold; and
    whether the runner failed on the sample. Outcome rows are summed per (sample, run) before the
    shuffle; a sample's runs, a small configured number, are then gathered in order."""
    failed = F.col("error_type") == RUNNER_ERROR if "error_type" in outcomes.columns else F.lit(False)
    per_run = outcomes.groupBy(id_col, "run").agg(
        F.count_if(F.col("status") == "success").alias("_ok"), F.count_if(failed).alias("_failed")
    )
    return per_run.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "_ok"))), lambda x: x["_ok"]).alias("_passed"),
        (F.sum("_failed") > 0).alias("_failed"),
    )


def verify_results(
    samples: DataFrame, outcomes: DataFrame, n_runs: int | None = None, id_col: str = "sample_id"
) -> DataFrame:
    """Per-sample verification result: status, mean pass rate, stability, run pass rates.

    Samples without solution or tests keep a status with null rates (left join from samples). The
    runs present in the outcomes count, however many there are; an executable sample without any
    has no run rates, rate 0 and status ``fail``. With ``n_runs`` the job fails if an executable
    sample that the runner could verify has another number of runs.
    """
    samples = _sample_flags(samples).select(id_col, "has_solution", "n_tests")
    joined = samples.join(run_pass_counts(outcomes, id_col), id_col, "left")
    executable = F.col("has_solution") & (F.col("n_tests") > 0)
    failed = executable & F.coalesce("_failed", F.lit(False))
    passed = F.coalesce("_passed", F.array().cast("array<bigint>"))
    if n_runs is not None:
        wrong = F.concat(F.lit(f"expected {n_runs} runs of sample "), F.col(id_col).cast("string"), F.lit(", found "), F.size(passed))
        passed = F.when(failed | (F.size(passed) == n_runs), passed).otherwise(F.raise_error(wrong).cast("array<bigint>"))
    staged = joined.select(id_col, "has_solution", "n_tests", F.when(executable, passed).alias("_passed"), failed.alias("_failed"))
    n = F.col("n_tests").cast("double")
    # the mean is total passed / (tests x runs): one division of exact integers, so it is the
    # correctly rounded mean (a left-to-right sum of rounded rates can fall just below 0.5)
    total = F.aggregate("_passed", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    runs = F.size("_passed")
    mean = F.when(runs > 0, total.cast("double") / (n * runs.cast("double"))).when(F.col("_passed").isNotNull(), F.lit(0.0))
    rated = staged.select("*", F.transform("_passed", lambda p: p.cast("double") / n).alias("_rates"), mean.alias("_mean"))
    spread = F.array_max("_rates") - F.array_min("_rates")
    stable = F.when(F.col("_rates").isNotNull(), F.coalesce(spread, F.lit(0.0)) < STABLE_SPREAD)
    # The names of the statuses. A sample that the runner could not verify has
    # status error, rate 0.0, is not stable and has no run rates.
    status = (
        F.when(F.col("_failed"), "error")
        .when(~F.col("has_solution"), "no_solution")
        .when(F.col("n_tests") == 0, "no_tests")
        .when((F.col("_mean") >= 1.0) & stable, "pass")
        .when(F.col("_mean") >= 0.5, "partial")
        .when(~stable, "flaky")
        .otherwise("fail")
    )
    failed = F.col("_failed")
    return rated.select(
        id_col,
        status.alias("status"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("_mean")).alias("pass_rate"),
        F.when(failed, F.lit(False)).otherwise(stable).alias("stable"),
        F.when(~failed, F.col("_rates")).alias("pass_rates"),
        F.when(failed, F.lit("runner could not verify the sample")).cast("string").alias("error"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    """Count and percent per status, by name, plus a ``Total`` row (rollup, one pass)."""
    agg = results.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("_g"))
    total = F.max("n").over(_one_window())
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("status")).alias("status"),
        "n",
        F.when(F.col("_g") == 1, F.lit("100%")).otherwise(pct1(F.col("n") / total)).alias("pct"),
    ).orderBy(F.col("status") == "Total", "status")


def _one_window():
    from pyspark.sql import Window

    # Only used over tiny, bounded results (one row per status).
    return Window.partitionBy(F.lit(0))


# ---------------------------------------------------------------- keep / complement

def kept_samples(samples: DataFrame, results: DataFrame, keep_status: Sequence[str] = ("pass",), id_col: str = "sample_id") -> DataFrame:
    ok = results.where(F.col("status").isin(*keep_status)).select(id_col)
    return samples.join(ok, id_col, "left_semi")


def failures(results: DataFrame, keep_status: Sequence[str] = ("pass",)) -> DataFrame:
    return results.where(~F.col("status").isin(*keep_status))


def unexecuted_samples(samples: DataFrame, outcomes: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Samples without any outcome row. The outcome keys are de-duplicated first (partial
    aggregation map-side), so a sample with a huge share of the outcome rows arrives at the
    anti-join as one row per map task instead of all its rows in one task."""
    return samples.join(outcomes.select(id_col).distinct(), id_col, "left_anti")


def failure_preview(
    results: DataFrame,
    samples: DataFrame,
    outcomes: DataFrame,
    keep_status: Sequence[str] = ("pass",),
    n_examples: int = 5,
    n_tests: int = 3,
    id_col: str = "sample_id",
) -> DataFrame:
    """First ``n_examples`` failures by id, with the first-run outcomes of their first ``n_tests``
    tests (only for samples that have a solution and tests). A top-k report: the limit is the feature."""
    from rewardframe.session import materialize

    # the head is at most n_examples rows: materialized once (so the results are not computed
    # twice) and broadcast to pick the outcomes of those samples without shuffling the outcomes
    head = materialize(failures(results, keep_status).orderBy(id_col).limit(n_examples))
    ids = F.broadcast(head.select(F.col(id_col).alias("_oid")))
    flags = (
        _sample_flags(samples)
        .select(id_col, "has_solution", "n_tests")
        .join(F.broadcast(head.select(id_col)), id_col, "left_semi")
    )
    base = head.join(flags, id_col, "left")
    first_run = (
        outcomes.where((F.col("run") == 0) & (F.col("test_idx") < n_tests))
        .select(
            F.col(id_col).alias("_oid"),
            F.col("test_idx"),
            F.col("status").alias("test_status"),
            F.col("error_type").alias("test_error_type"),
        )
        .join(ids, "_oid", "left_semi")
    )
    cond = (F.col(id_col) == F.col("_oid")) & F.col("has_solution") & (F.col("n_tests") > 0)
    return base.join(first_run, cond, "left").select(
        id_col, "status", "pass_rate", "test_idx", "test_status", "test_error_type"
    )


def verify_report(results: DataFrame, keep_status: Sequence[str] = ("pass",)) -> DataFrame:
    """One-row report: total, counts per status (map), kept, filter status. The per-sample
    results stay a separate table (they do not fit one JSON value at scale). Ids are unique
    (see ``with_position_id``), so ``kept`` is the number of results with a kept status."""
    by_status = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return by_status.agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*keep_status), F.col("n"))), F.lit(0)).alias("kept"),
        F.array(*[F.lit(s) for s in keep_status]).alias("filter_status"),
    )


def write_verify_report(report: DataFrame, results: DataFrame, path: str) -> None:
    """Report as one JSON object, results as Parquet next to it (K6)."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    results.write.mode("overwrite").parquet(f"{path}/results")

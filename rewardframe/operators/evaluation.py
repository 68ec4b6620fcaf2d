"""Evaluation: pass@1 / pass@k, benchmark x model comparison, evaluator-log scores, metric
series, rollout metrics, benchmark test lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardframe.functions.text import assert_lines, basename, col_, pct1, py_strip

# Fixed values that must equal the reference's for equal results.
BASE_MARKER = "(base tests)"
PLUS_MARKER = "(base + extra tests)"
SCORE_TAG = "pass@"
MAX_BENCH_TESTS = 5
DEGENERATE_STD = 1e-6


# ------------------------------------------------------------------ pass@k

def item_flags(samples: DataFrame, bench_col: str, item_col: str, idx_col: str, passed_col: str) -> DataFrame:
    """Per item: first sample's flag (by sample index), any flag, mean flag, sample count."""
    p = F.col(passed_col)
    return samples.groupBy(bench_col, item_col).agg(
        F.min_by(p, F.col(idx_col)).alias("first_passed"),
        F.bool_or(p).alias("any_passed"),
        F.avg(p.cast("double")).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_generated"),
    )


def pass_at_k(samples: DataFrame, bench_col: str = "bench", item_col: str = "item_id", idx_col: str = "sample_idx", passed_col: str = "passed") -> DataFrame:
    """pass@1 = mean of the first flag, pass@k = mean of any flag (as the reference computes;
    not the unbiased estimator); two aggregations, the second over one row per item."""
    items = item_flags(samples, bench_col, item_col, idx_col, passed_col)
    return items.groupBy(bench_col).agg(
        F.avg(F.col("first_passed").cast("double")).alias("pass_at_1"),
        F.avg(F.col("any_passed").cast("double")).alias("pass_at_k"),
        F.count(F.lit(1)).alias("n_samples"),
        F.max("n_generated").alias("k"),
    )


# ------------------------------------------------------------------ benchmark comparison

def compare_models(results: DataFrame, model_names: Sequence[str], name_col: str = "name", model_col: str = "model_name",
                   value_col: str = "pass_at_1", seq_col: str = "seq") -> DataFrame:
    """One row per benchmark (every benchmark, sorted), one column per chosen model, named as the
    model is: pass@1 of the model's first result as a percent, ``N/A`` if none.

    One aggregation over the results: per model a conditional ``min_by`` (the ordering value is
    null for other models' rows, which ``min_by`` skips). Grouping all results by benchmark keeps
    the benchmarks without any chosen model, so no separate distinct or join is needed; the
    percent text is formatted after aggregation so a missing cell is ``N/A``.
    """
    is_m = {m: F.col(model_col) == F.lit(m) for m in model_names}
    firsts = [
        F.min_by(F.when(is_m[m], F.col(value_col)), F.when(is_m[m], F.col(seq_col))).alias(f"_m{i}")
        for i, m in enumerate(model_names)
    ]
    wide = results.groupBy(name_col).agg(*firsts)
    cols = [F.col(name_col)]
    for i, m in enumerate(model_names):
        cols.append(F.coalesce(pct1(F.col(f"_m{i}")), F.lit("N/A")).alias(m))
    return wide.select(*cols).orderBy(name_col)


# ------------------------------------------------------------------ evaluator logs

def log_score_from_lines(lines: Column, marker: str = BASE_MARKER) -> Column:
    """Score after a marker line, given the log's lines as an array column: among each marker
    line and the line after it, the first line holding ``pass@`` (any case); its second
    blank-separated field. Null when none."""
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.instr(F.element_at(lines, i), marker) > 0)
    cand = F.flatten(F.transform(hits, lambda i: F.array(F.element_at(lines, i), F.try_element_at(lines, i + 1))))
    found = F.try_element_at(F.filter(cand, lambda s: F.instr(F.lower(s), SCORE_TAG) > 0), F.lit(1))
    fields = F.split(F.regexp_replace(found, r"^[ \t]+", ""), r"[ \t]+")
    return F.nullif(F.try_element_at(fields, F.lit(2)), F.lit(""))


def log_lines(log: str | Column) -> Column:
    return F.split(F.coalesce(col_(log), F.lit("")), "\n")


def eval_log_scores(logs: DataFrame, log_col: str = "log", exit_col: str = "exit_code", keep: Sequence[str] = ()) -> DataFrame:
    """Base and plus scores per evaluator log: ``Error`` on a non-zero exit, ``N/A`` when missing.
    The log is split into lines once (a named column), then both markers are searched."""
    staged = logs.select(*keep, exit_col, log_lines(log_col).alias("_lines"))

    def shown(marker: str) -> Column:
        return F.when(F.col(exit_col) != 0, F.lit("Error")).otherwise(
            F.coalesce(log_score_from_lines(F.col("_lines"), marker), F.lit("N/A"))
        )

    return staged.select(*keep, shown(BASE_MARKER).alias("base_score"), shown(PLUS_MARKER).alias("plus_score"))


# ------------------------------------------------------------------ metric log

def metric_series(log: DataFrame, step_col: str = "step", series: Sequence[str] = ("loss", "eval_loss")) -> DataFrame:
    """Long form (series, step, value) of the rows that carry each series, sorted by step."""
    stacked = log.unpivot([step_col], list(series), "series", "value")
    return stacked.where(F.col("value").isNotNull()).orderBy("series", step_col)


# ------------------------------------------------------------------ rollout metrics

def rollout_metrics(rollouts: DataFrame, group_col: str = "prompt_id", reward_col: str = "reward",
                    runnable_col: str = "runnable", passed_col: str = "passed") -> DataFrame:
    """Per group: reward mean, population std, pass rate, runnable rate, degenerate flag."""
    return rollouts.groupBy(group_col).agg(
        F.avg(reward_col).alias("reward_mean"),
        F.stddev_pop(reward_col).alias("reward_std"),
        F.avg(F.col(passed_col).cast("double")).alias("pass_rate"),
        F.avg(F.col(runnable_col).cast("double")).alias("runnable_rate"),
        (F.stddev_pop(reward_col) < DEGENERATE_STD).alias("is_degenerate"),
        F.count(F.lit(1)).alias("n"),
    )


def distinct_2(rollouts: DataFrame, group_col: str = "prompt_id", text_col: str = "response") -> DataFrame:
    """Distinct word bigrams / all word bigrams per group (0.0 without bigrams).

    Words are split once into a column, bigrams paired with ``zip_with`` over the two shifted
    slices (no per-element re-split) and exploded (narrow); the distinct count is Spark's
    two-phase distinct aggregation, so a very large group is de-duplicated across tasks first.
    """
    words = rollouts.select(group_col, F.split(py_strip(F.col(text_col)), r"(?U)\s+").alias("_w"))
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_w", 1, n), F.slice("_w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    exploded = words.select(group_col, F.explode_outer(pairs).alias("bigram"))
    agg = exploded.groupBy(group_col).agg(F.count_distinct("bigram").alias("n_distinct"), F.count("bigram").alias("n_bigrams"))
    return agg.select(
        group_col, "n_distinct", "n_bigrams",
        F.coalesce(F.try_divide(F.col("n_distinct").cast("double"), F.nullif(F.col("n_bigrams").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("distinct_2"),
    )


# ------------------------------------------------------------------ benchmark test lists

def humaneval_tests(test_text: str | Column, limit: int = MAX_BENCH_TESTS) -> Column:
    return assert_lines(test_text, limit)


def mbpp_tests(test_list: str | Column, limit: int = MAX_BENCH_TESTS) -> Column:
    return F.slice(col_(test_list), 1, limit)


def with_tests_only(df: DataFrame, tests_col: str = "tests") -> DataFrame:
    return df.where(F.size(tests_col) > 0)


# ------------------------------------------------------------------ formatted summaries (K8)

def benchmark_summary(results: DataFrame, model_col: str = "model_name", name_col: str = "name",
                      p1_col: str = "pass_at_1", pk_col: str = "pass_at_k", temp_col: str = "temperature") -> DataFrame:
    """Benchmark summary table: model (last path component), benchmark, pass@1 and pass@k as
    percent text with one decimal, temperature with two decimals."""
    return results.select(
        basename(model_col).alias("model"),
        F.col(name_col).alias("benchmark"),
        pct1(p1_col).alias("pass_at_1"),
        pct1(pk_col).alias("pass_at_k"),
        F.format_string("%.2f", F.col(temp_col).cast("double")).alias("temp"),
    )


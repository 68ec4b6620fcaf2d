"""Reward scoring: outcome counts, stepped reward shaping, reasons, manager statistics, advantage.

Shapes
------
scored    : one row per response: ``id_col`` plus either raw ``response``/``tests_text`` (see
            ``prepare_responses``) or the validation flags ``has_code, syntax_valid,
            compile_valid`` with ``n_tests`` and ``code_length``
outcomes  : one row per executed test of a response: ``id_col, status`` (+ ``error_type``,
            ``run_time_s`` optional)
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardframe.functions.code import check_code
from rewardframe.functions.tests_parse import with_tests
from rewardframe.functions.text import fence_last, is_blank, py_strip
from rewardframe.operators.verify import RUNNER_ERROR, plan_executions

# Fixed values that must equal the reference's for equal results: the 17 reward columns, in order.
REWARD_COLUMNS = [
    "reward", "score", "pass_rate", "passed", "total", "acc", "has_code", "syntax_valid",
    "compile_valid", "format_error", "syntax_error", "compile_error", "timeout_count",
    "runtime_error_count", "code_length", "is_markdown", "execution_time",
]
# Fixed values that must equal the reference's for equal results.
CRASH_REWARD = -2.0
NO_TESTS_BONUS = 0.2


@dataclass(frozen=True)
class RewardConfig:
    """Stepped reward configuration; fixed default values of the reference.

    A partial override keeps the defaults of the keys it does not name.
    """

    format_penalty: float = -1.5
    syntax_error_penalty: float = -1.0
    compile_error_penalty: float = -0.5
    execution_base_reward: float = 0.0
    runtime_error_penalty: float = -0.2
    timeout_penalty: float = -0.3
    pass_rate_weight: float = 2.0
    full_pass_bonus: float = 1.0

    def with_overrides(self, **kw) -> "RewardConfig":
        return replace(self, **kw)

    def as_dict(self) -> dict:
        return asdict(self)


# ------------------------------------------------------------------ code and tests of a response

def with_checked_code(df: DataFrame, response_col: str = "response", out: str = "code") -> DataFrame:
    """Code of every response and whether it is valid: ``out``, has_code, syntax_valid,
    compile_valid.

    The code is the last fenced block, stripped; without a fence it is the whole text, stripped,
    if that parses as Python, else ''. Each candidate is handed to Python once, in one Arrow pass
    that gives both the choice and the verdict (a text that parses does so stripped, too)."""
    r = F.col(response_col)
    keep = [c for c in df.columns if c not in (out, "has_code", "syntax_valid", "compile_valid")]
    fenced = df.select("*", fence_last(r).alias("__wc_f"))
    candidate = F.coalesce("__wc_f", r)
    checked = fenced.select("*", check_code(F.when(~is_blank(candidate), candidate)).alias("__wc_v"))
    parses, compiles = (F.coalesce(F.col(f"__wc_v.{c}"), F.lit(False)) for c in ("parses", "compiles"))
    code = F.when(F.col("__wc_f").isNotNull(), F.col("__wc_f")).when(parses, py_strip(r)).otherwise(F.lit(""))
    staged = checked.select(*keep, code.alias(out), parses.alias("syntax_valid"), compiles.alias("compile_valid"))
    return staged.select(*keep, out, (F.col(out) != "").alias("has_code"), "syntax_valid", "compile_valid")


def prepare_responses(df: DataFrame, response_col: str = "response", tests_col: str = "tests_text") -> DataFrame:
    """Code, tests and validation flags of every response (one Arrow pass for code and flags)."""
    staged = with_tests(with_checked_code(df, response_col, "code"), tests_col, "tests")
    return staged.withColumns({"n_tests": F.size("tests"), "code_length": F.length("code")})


def plan_scoring(prepared: DataFrame, id_col: str = "sample_id", timeout_s: float = 5.0) -> DataFrame:
    """Execution plan for scoring: one row per test of the responses whose code has passed
    validation (``prepare_responses``); no other code reaches the runner."""
    valid = prepared.where("has_code AND syntax_valid AND compile_valid")
    return plan_executions(valid, 1, id_col, "code", "tests", timeout_s)


# ------------------------------------------------------------------ counts per response (A4)

def outcome_counts(outcomes: DataFrame, id_col: str = "sample_id", timeout_as: str = "error") -> DataFrame:
    """passed / timeouts / runtime errors / outcome rows per response, one aggregation.

    ``timeout_as='error'``: a time-out is status ``error`` (as the executor reports it), so it
    counts as a runtime error; ``'timeout'``: rows with error type ``TIMEOUT`` count as time-outs.
    A row with error type ``RUNNER_ERROR`` says that scoring the response raised (``crashed_n``).
    """
    status = F.col("status")
    if timeout_as == "timeout" and "error_type" in outcomes.columns:
        status = F.when((status != "success") & (F.col("error_type") == "TIMEOUT"), F.lit("timeout")).otherwise(status)
    elif timeout_as not in ("error", "timeout"):
        raise ValueError("timeout_as must be 'error' or 'timeout'")
    crashed = F.lit(0).cast("bigint")
    if "error_type" in outcomes.columns:
        crashed = F.count_if(F.col("error_type") == RUNNER_ERROR)
    run_time = F.sum(F.col("run_time_s")) if "run_time_s" in outcomes.columns else F.lit(0.0)
    return outcomes.groupBy(id_col).agg(
        F.count_if(status == "success").alias("passed_n"),
        F.count_if(status == "timeout").alias("timeouts_n"),
        F.count_if(status.isin("error", "runtime_error")).alias("runtime_errors_n"),
        F.count(F.lit(1)).alias("outcomes_n"),
        crashed.alias("crashed_n"),
        run_time.cast("double").alias("execution_time"),
    )


# ------------------------------------------------------------------ shaping

def _d(x) -> Column:
    return F.lit(float(x))


def shape_columns(cfg: RewardConfig = RewardConfig()) -> list[Column]:
    """The 17 reward columns from flags and counts; first matching case wins.

    Inputs: has_code, syntax_valid, compile_valid, n_tests, code_length, passed_n, timeouts_n,
    runtime_errors_n, outcomes_n, execution_time (counts null when the response ran nothing).
    A null ``has_code`` marks a response whose scoring raised: it gets the crash reward.
    """
    has_code, syn, comp = F.col("has_code"), F.col("syntax_valid"), F.col("compile_valid")
    n = F.col("n_tests").cast("double")
    passed = F.coalesce(F.col("passed_n"), F.lit(0)).cast("double")
    timeouts = F.coalesce(F.col("timeouts_n"), F.lit(0)).cast("double")
    rt = F.coalesce(F.col("runtime_errors_n"), F.lit(0)).cast("double")
    ran = F.coalesce(F.col("outcomes_n"), F.lit(0)) > 0
    clen = F.coalesce(F.col("code_length"), F.lit(0)).cast("double")
    etime = F.coalesce(F.col("execution_time"), F.lit(0.0))

    crash = has_code.isNull()
    blank = ~has_code
    bad_syntax = ~syn
    bad_compile = ~comp
    no_tests = (n == 0) | ~ran
    executed = ~(crash | blank | bad_syntax | bad_compile | no_tests)

    pass_rate = passed / n
    full = passed == n
    penalty = (
        F.when(timeouts > 0, _d(cfg.timeout_penalty))
        .when((rt > 0) & (passed == 0), _d(cfg.runtime_error_penalty))
        .otherwise(_d(0.0))
    )
    run_reward = (
        _d(cfg.execution_base_reward) + penalty
        + F.when(passed > 0, pass_rate * _d(cfg.pass_rate_weight)).otherwise(_d(0.0))
        + F.when(full, _d(cfg.full_pass_bonus)).otherwise(_d(0.0))
    )
    reward = (
        F.when(crash, _d(CRASH_REWARD))
        .when(blank, _d(cfg.format_penalty))
        .when(bad_syntax, _d(cfg.syntax_error_penalty))
        .when(bad_compile, _d(cfg.compile_error_penalty))
        .when(no_tests, _d(cfg.execution_base_reward) + _d(NO_TESTS_BONUS))
        .otherwise(run_reward)
    )

    def flag(cond: Column) -> Column:
        return F.when(cond, _d(1.0)).otherwise(_d(0.0))

    zero = _d(0.0)
    total = F.when(crash | blank, zero).when(bad_syntax | bad_compile, n).when(no_tests, zero).otherwise(n)
    return [
        reward.alias("reward"),
        reward.alias("score"),
        F.when(executed, pass_rate).otherwise(zero).alias("pass_rate"),
        F.when(executed, passed).otherwise(zero).alias("passed"),
        total.alias("total"),
        flag(executed & full).alias("acc"),
        flag(~crash & has_code).alias("has_code"),
        flag(~crash & has_code & syn).alias("syntax_valid"),
        flag(~crash & has_code & syn & comp).alias("compile_valid"),
        flag(~crash & blank).alias("format_error"),
        flag(~crash & has_code & bad_syntax).alias("syntax_error"),
        flag(~crash & has_code & syn & bad_compile).alias("compile_error"),
        F.when(executed, timeouts).otherwise(zero).alias("timeout_count"),
        F.when(executed, rt).otherwise(zero).alias("runtime_error_count"),
        F.when(crash, zero).otherwise(clen).alias("code_length"),
        zero.alias("is_markdown"),
        F.when(crash, zero).otherwise(etime).alias("execution_time"),
    ]


def reason_columns() -> list[Column]:
    """``failure_reason`` of the validator and the shaper's ``reason`` (last assignment wins)."""
    has_code, syn, comp = F.col("has_code"), F.col("syntax_valid"), F.col("compile_valid")
    passed = F.coalesce(F.col("passed_n"), F.lit(0))
    timeouts = F.coalesce(F.col("timeouts_n"), F.lit(0))
    rt = F.coalesce(F.col("runtime_errors_n"), F.lit(0))
    ran = F.coalesce(F.col("outcomes_n"), F.lit(0)) > 0
    n = F.col("n_tests")
    # The names of the reasons. A response whose scoring raised has none.
    failure = (
        F.when(has_code.isNull(), F.lit(None))
        .when(~has_code, "empty_or_format")
        .when(~syn, "syntax")
        .when(~comp, "compile")
        .otherwise("none")
    )
    reason = (
        F.when(has_code.isNull(), F.lit(None))
        .when(~has_code, "format_or_empty_error")
        .when(~syn, "syntax_error")
        .when(~comp, "compile_error")
        .when((n == 0) | ~ran, "no_tests")
        .when(passed == n, "full_pass")
        .when(passed > 0, "partial_pass")
        .when(timeouts > 0, "timeout")
        .when(rt > 0, "runtime_error")
        .otherwise("zero_pass")
    )
    return [failure.alias("failure_reason"), reason.alias("reason")]


def score(
    scored: DataFrame,
    outcomes: DataFrame | None,
    cfg: RewardConfig = RewardConfig(),
    id_col: str = "sample_id",
    timeout_as: str = "error",
    keep: tuple[str, ...] = (),
    with_reasons: bool = False,
) -> DataFrame:
    """Reward row per response: flags (``prepare_responses`` or given) left-joined to the
    per-response outcome counts, then pure column arithmetic.

    The counts are aggregated before the join (map-side partial aggregation), so the join
    moves one small row per response, never the outcome rows. ``outcomes`` may be counts already
    (``outcome_counts``): a stream of responses then does not aggregate them at every batch.
    """
    if outcomes is not None:
        counts = outcomes if "passed_n" in outcomes.columns else outcome_counts(outcomes, id_col, timeout_as)
        joined = scored.join(counts, id_col, "left")
        # a response whose scoring raised loses its flags and gets the crash row
        joined = joined.withColumn("has_code", F.when(F.coalesce("crashed_n", F.lit(0)) == 0, F.col("has_code")))
    else:
        joined = scored
        for c, v in [("passed_n", 0), ("timeouts_n", 0), ("runtime_errors_n", 0), ("outcomes_n", 0), ("execution_time", 0.0)]:
            joined = joined.withColumn(c, F.lit(v))
    cols = [F.col(id_col), *[F.col(k) for k in keep], *shape_columns(cfg)]
    if with_reasons:
        cols += reason_columns()
    return joined.select(*cols)


# ------------------------------------------------------------------ manager statistics (A5 A10)

def manager_stats(rewards: DataFrame) -> DataFrame:
    """Totals and rates over scored rows; rates are null when there is nothing scored.

    ``runtime_errors`` is declared by the reference and never counted: always 0.
    """
    total = F.count(F.lit(1))
    empty = F.count_if(F.col("format_error") == 1.0)
    syntax = F.count_if(F.col("syntax_error") == 1.0)
    compile_ = F.count_if(F.col("compile_error") == 1.0)
    full = F.count_if(F.col("acc") == 1.0)
    agg = rewards.agg(
        total.alias("total_samples"), empty.alias("empty_samples"), syntax.alias("syntax_errors"),
        compile_.alias("compile_errors"), F.lit(0).cast("bigint").alias("runtime_errors"), full.alias("full_pass"),
    )
    t = F.col("total_samples").cast("double")
    return agg.select(
        "*",
        F.try_divide(F.col("empty_samples").cast("double"), F.nullif(t, F.lit(0.0))).alias("empty_rate"),
        F.try_divide(F.col("syntax_errors").cast("double"), F.nullif(t, F.lit(0.0))).alias("syntax_error_rate"),
        F.try_divide(F.col("compile_errors").cast("double"), F.nullif(t, F.lit(0.0))).alias("compile_error_rate"),
        F.try_divide(F.col("full_pass").cast("double"), F.nullif(t, F.lit(0.0))).alias("full_pass_rate"),
    )


def pass_rate_of(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Share of ``success`` outcomes per group; an empty group is 0.0."""
    return outcomes.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)), F.lit(0.0)).alias("pass_rate")
    )


# ------------------------------------------------------------------ group-relative advantage

def group_advantage(rollouts: DataFrame, group_col: str = "prompt_id", reward_col: str = "reward", eps: float = 1e-6) -> DataFrame:
    """(reward - group mean) / (group sample std + eps); a group of one has advantage 0. Rows
    without a group are one group.

    Group statistics are an aggregation (partial sums map-side, so a prompt with a huge share of
    the rollouts never sits in one task) joined back on the prompt key, null-safe. The planner
    broadcasts the statistics only if they are small; else the join's shuffle is a plain one,
    whose skewed partitions adaptive execution splits."""
    stats = rollouts.groupBy(F.col(group_col).alias("_group")).agg(
        F.avg(reward_col).alias("group_mean"),
        F.coalesce(F.stddev_samp(reward_col), F.lit(0.0)).alias("group_std"),
    )
    joined = rollouts.join(stats, F.col(group_col).eqNullSafe(F.col("_group")), "left")
    return joined.select(
        *rollouts.columns,
        "group_mean",
        "group_std",
        ((F.col(reward_col) - F.col("group_mean")) / (F.col("group_std") + F.lit(eps))).alias("advantage"),
    )

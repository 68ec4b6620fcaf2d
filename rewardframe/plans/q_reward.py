"""Reward queries: shaping (both time-out modes, custom config), reasons, statistics, advantage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardframe.operators import reward as RW
from rewardframe.plans.fixtures import fixture, oracle_with
from rewardframe.plans.registry import r6, register

# Responses of the scoring fixture: validation state and length derived from the sample id.
_SCORED_SQL = """
scored as (
  select sample_id, has_solution as has_code,
    has_solution and sample_id % 7 <> 3 as syntax_valid,
    has_solution and sample_id % 7 <> 3 and sample_id % 11 <> 5 as compile_valid,
    n_tests, case when has_solution then sample_id % 50 + 10 else 0 end as code_length
  from fx_samples),
outs as (
  select sample_id, test_idx, status,
    case when status <> 'success' then error_type_if_failed end as error_type
  from fx_verdicts where run = 0)
"""


def _scored(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_samples")
    v = fixture(spark, sf_dir, "fx_verdicts")
    ok = F.col("has_solution")
    scored = s.select(
        "sample_id",
        ok.alias("has_code"),
        (ok & (F.col("sample_id") % 7 != 3)).alias("syntax_valid"),
        (ok & (F.col("sample_id") % 7 != 3) & (F.col("sample_id") % 11 != 5)).alias("compile_valid"),
        "n_tests",
        F.when(ok, F.col("sample_id") % 50 + 10).otherwise(F.lit(0)).alias("code_length"),
    )
    outs = v.where(F.col("run") == 0).select(
        "sample_id", "test_idx", "status",
        F.when(F.col("status") != "success", F.col("error_type_if_failed")).alias("error_type"),
    )
    return scored, outs


def _counts_sql(timeout_as: str) -> str:
    st = (
        "case when status <> 'success' and error_type = 'TIMEOUT' then 'timeout' else status end"
        if timeout_as == "timeout"
        else "status"
    )
    return f"""
counts as (
  select sample_id, count(*) filter (where st = 'success') as p, count(*) filter (where st = 'timeout') as t,
    count(*) filter (where st in ('error', 'runtime_error')) as e, count(*) as o
  from (select sample_id, {st} as st from outs) x group by sample_id),
k as (
  select s.*, coalesce(c.p, 0) as p, coalesce(c.t, 0) as t, coalesce(c.e, 0) as e, coalesce(c.o, 0) as o,
    case when not s.has_code then 'blank' when not s.syntax_valid then 'syntax'
         when not s.compile_valid then 'compile' when s.n_tests = 0 or coalesce(c.o, 0) = 0 then 'none'
         else 'run' end as cls
  from scored s left join counts c on c.sample_id = s.sample_id)
"""


def _shaping_sql(timeout_as: str, cfg: RW.RewardConfig) -> str:
    c = cfg
    reward = f"""case cls when 'blank' then {c.format_penalty}::double when 'syntax' then {c.syntax_error_penalty}::double
      when 'compile' then {c.compile_error_penalty}::double when 'none' then {c.execution_base_reward}::double + 0.2::double
      else {c.execution_base_reward}::double
        + (case when t > 0 then {c.timeout_penalty}::double when e > 0 and p = 0 then {c.runtime_error_penalty}::double else 0.0::double end)
        + (case when p > 0 then (p::double / n_tests::double) * {c.pass_rate_weight}::double else 0.0::double end)
        + (case when p = n_tests then {c.full_pass_bonus}::double else 0.0::double end) end"""
    run = "cls = 'run'"
    return (
        oracle_with("fx_samples", "fx_verdicts").rstrip()
        + ",\n"
        + _SCORED_SQL.strip()
        + ",\n"
        + _counts_sql(timeout_as).strip()
        + f"""
select sample_id,
  round({reward}, 6) as reward,
  round({reward}, 6) as score,
  round(case when {run} then p::double / n_tests::double else 0.0 end, 6) as pass_rate,
  case when {run} then p::double else 0.0 end as passed,
  case when cls in ('blank', 'none') then 0.0 else n_tests::double end as total,
  case when {run} and p = n_tests then 1.0::double else 0.0::double end as acc,
  case when has_code then 1.0::double else 0.0::double end as has_code,
  case when has_code and syntax_valid then 1.0::double else 0.0::double end as syntax_valid,
  case when has_code and syntax_valid and compile_valid then 1.0::double else 0.0::double end as compile_valid,
  case when not has_code then 1.0::double else 0.0::double end as format_error,
  case when cls = 'syntax' then 1.0::double else 0.0::double end as syntax_error,
  case when cls = 'compile' then 1.0::double else 0.0::double end as compile_error,
  case when {run} then t::double else 0.0 end as timeout_count,
  case when {run} then e::double else 0.0 end as runtime_error_count,
  code_length::double as code_length,
  0.0::double as is_markdown,
  0.0::double as execution_time
from k
"""
    )


def _shaping(spark, sf_dir, timeout_as: str, cfg: RW.RewardConfig):
    scored, outs = _scored(spark, sf_dir)
    res = RW.score(scored, outs, cfg, timeout_as=timeout_as)
    return res.select("sample_id", *[r6(c).alias(c) for c in RW.REWARD_COLUMNS])


_CUSTOM = RW.RewardConfig().with_overrides(format_penalty=-2.5, pass_rate_weight=1.5, full_pass_bonus=0.5)


@register("reward_shaping", _shaping_sql("error", RW.RewardConfig()))
def reward_shaping(spark, sf_dir):
    return _shaping(spark, sf_dir, "error", RW.RewardConfig())


@register("reward_shaping_timeouts", _shaping_sql("timeout", RW.RewardConfig()))
def reward_shaping_timeouts(spark, sf_dir):
    return _shaping(spark, sf_dir, "timeout", RW.RewardConfig())


@register("reward_shaping_custom", _shaping_sql("error", _CUSTOM))
def reward_shaping_custom(spark, sf_dir):
    return _shaping(spark, sf_dir, "error", _CUSTOM)


@register(
    "reward_reasons",
    oracle_with("fx_samples", "fx_verdicts").rstrip() + ",\n" + _SCORED_SQL.strip() + ",\n" + _counts_sql("timeout").strip()
    + """
select sample_id,
  case when not has_code then 'empty_or_format' when not syntax_valid then 'syntax'
       when not compile_valid then 'compile' else 'none' end as failure_reason,
  case cls when 'blank' then 'format_or_empty_error' when 'syntax' then 'syntax_error'
       when 'compile' then 'compile_error' when 'none' then 'no_tests'
       else case when p = n_tests then 'full_pass' when p > 0 then 'partial_pass' when t > 0 then 'timeout'
                 when e > 0 then 'runtime_error' else 'zero_pass' end end as reason
from k
""",
)
def reward_reasons(spark, sf_dir):
    scored, outs = _scored(spark, sf_dir)
    res = RW.score(scored, outs, timeout_as="timeout", with_reasons=True)
    return res.select("sample_id", "failure_reason", "reason")


@register(
    "reward_stats",
    oracle_with("fx_samples", "fx_verdicts").rstrip() + ",\n" + _SCORED_SQL.strip() + ",\n" + _counts_sql("error").strip()
    + """
select count(*) as total_samples,
  count(*) filter (where cls = 'blank') as empty_samples,
  count(*) filter (where cls = 'syntax') as syntax_errors,
  count(*) filter (where cls = 'compile') as compile_errors,
  cast(0 as bigint) as runtime_errors,
  count(*) filter (where cls = 'run' and p = n_tests) as full_pass,
  round(count(*) filter (where cls = 'blank') / count(*)::double, 6) as empty_rate,
  round(count(*) filter (where cls = 'syntax') / count(*)::double, 6) as syntax_error_rate,
  round(count(*) filter (where cls = 'compile') / count(*)::double, 6) as compile_error_rate,
  round(count(*) filter (where cls = 'run' and p = n_tests) / count(*)::double, 6) as full_pass_rate
from k
""",
)
def reward_stats(spark, sf_dir):
    scored, outs = _scored(spark, sf_dir)
    st = RW.manager_stats(RW.score(scored, outs))
    return st.select(
        *[c for c in st.columns if not c.endswith("_rate")],
        *[r6(c).alias(c) for c in st.columns if c.endswith("_rate")],
    )


@register(
    "outcome_pass_rate",
    oracle_with("fx_verdicts")
    + """
select sample_id, run, round(avg(case when status = 'success' then 1.0::double else 0.0::double end)::double, 6) as pass_rate
from fx_verdicts group by sample_id, run
""",
)
def outcome_pass_rate(spark, sf_dir):
    v = fixture(spark, sf_dir, "fx_verdicts")
    return RW.pass_rate_of(v, ["sample_id", "run"]).select("sample_id", "run", r6("pass_rate").alias("pass_rate"))


@register(
    "rollout_advantage",
    oracle_with("fx_rollouts")
    + """
select prompt_id, sample_idx, round(reward, 6) as reward,
  round(avg(reward) over w, 6) as group_mean,
  round(coalesce(stddev_samp(reward) over w, 0.0), 6) as group_std,
  round((reward - avg(reward) over w) / (coalesce(stddev_samp(reward) over w, 0.0) + 1e-6), 6) as advantage
from fx_rollouts window w as (partition by prompt_id)
""",
)
def rollout_advantage(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_rollouts")
    adv = RW.group_advantage(r.select("prompt_id", "sample_idx", "reward"))
    return adv.select("prompt_id", "sample_idx", *[r6(c).alias(c) for c in ("reward", "group_mean", "group_std", "advantage")])

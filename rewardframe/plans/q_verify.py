"""Verification queries over ``fx_samples`` / ``fx_verdicts`` / ``fx_outcomes``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardframe.operators import verify as V
from rewardframe.plans.fixtures import fixture, oracle_with
from rewardframe.plans.registry import join_doubles, r6, register
from rewardframe.sources.sinks import scratch_dir

# ----------------------------------------------------------------------------- shared oracle text

_RESULTS_SQL = """
runs as (
  select sample_id, run, cast(count(*) filter (where status = 'success') as double) as passed
  from fx_verdicts group by sample_id, run),
agg as (
  select r.sample_id, s.n_tests,
    sum(r.passed) / (s.n_tests * count(*)) as mean_rate,
    max(r.passed / s.n_tests) - min(r.passed / s.n_tests) as spread,
    string_agg(cast(round(r.passed / s.n_tests, 6) as varchar), ',' order by r.run) as rates
  from runs r join fx_samples s on s.sample_id = r.sample_id
  group by r.sample_id, s.n_tests),
results as (
  select s.sample_id,
    case when not s.has_solution then 'no_solution'
         when s.n_tests = 0 then 'no_tests'
         when a.mean_rate >= 1.0 and a.spread < 0.1 then 'pass'
         when a.mean_rate >= 0.5 then 'partial'
         when not (a.spread < 0.1) then 'flaky'
         else 'fail' end as status,
    case when s.has_solution and s.n_tests > 0 then round(a.mean_rate, 6) end as pass_rate,
    case when s.has_solution and s.n_tests > 0 then a.spread < 0.1 end as stable,
    case when s.has_solution and s.n_tests > 0 then a.rates end as pass_rates
  from fx_samples s left join agg a on a.sample_id = s.sample_id)
"""


def _results(spark, sf_dir):
    samples = fixture(spark, sf_dir, "fx_samples")
    verdicts = fixture(spark, sf_dir, "fx_verdicts")
    return samples, verdicts, V.verify_results(samples, verdicts)


def _with_results() -> str:
    return oracle_with("fx_samples", "fx_verdicts").rstrip() + ",\n" + _RESULTS_SQL.strip() + "\n"


# ----------------------------------------------------------------------------- queries

@register(
    "verify_status_counts",
    _with_results()
    + """
select coalesce(status, 'Total') as status, count(*) as n,
  case when grouping(status) = 1 then '100%'
       else concat(cast(round(count(*) * 100.0 / (select count(*) from results), 1) as varchar), '%') end as pct
from results group by rollup (status)
""",
)
def verify_status_counts(spark, sf_dir):
    _, _, results = _results(spark, sf_dir)
    return V.status_counts(results)


@register(
    "verify_results",
    _with_results() + "select sample_id, status, pass_rate, stable, pass_rates from results",
)
def verify_results(spark, sf_dir):
    _, _, res = _results(spark, sf_dir)
    return res.select("sample_id", "status", r6("pass_rate").alias("pass_rate"), "stable",
                      join_doubles(F.col("pass_rates")).alias("pass_rates"))


@register(
    "verify_kept_samples",
    _with_results()
    + "select s.* from fx_samples s where s.sample_id in (select sample_id from results where status in ('pass'))",
)
def verify_kept_samples(spark, sf_dir):
    samples, _, res = _results(spark, sf_dir)
    return V.kept_samples(samples, res, ("pass",))


@register(
    "verify_kept_samples_partial",
    _with_results()
    + "select s.* from fx_samples s where s.sample_id in (select sample_id from results where status in ('pass', 'partial'))",
)
def verify_kept_samples_partial(spark, sf_dir):
    samples, _, res = _results(spark, sf_dir)
    return V.kept_samples(samples, res, ("pass", "partial"))


@register(
    "verify_unexecuted",
    oracle_with("fx_samples", "fx_verdicts")
    + "select s.* from fx_samples s where not exists (select 1 from fx_verdicts v where v.sample_id = s.sample_id)",
)
def verify_unexecuted(spark, sf_dir):
    samples = fixture(spark, sf_dir, "fx_samples")
    verdicts = fixture(spark, sf_dir, "fx_verdicts")
    return V.unexecuted_samples(samples, verdicts)


@register(
    "verify_failure_preview",
    _with_results()
    + """,
head as (select * from results where status not in ('pass') order by sample_id limit 5)
select h.sample_id, h.status, h.pass_rate, v.test_idx, v.status as test_status,
  case when v.status = 'success' then null else v.error_type_if_failed end as test_error_type
from head h join fx_samples s on s.sample_id = h.sample_id
left join fx_verdicts v on v.sample_id = h.sample_id and v.run = 0 and v.test_idx < 3
  and s.has_solution and s.n_tests > 0
""",
)
def verify_failure_preview(spark, sf_dir):
    samples, verdicts, res = _results(spark, sf_dir)
    outcomes = verdicts.withColumn(
        "error_type", F.when(F.col("status") != "success", F.col("error_type_if_failed"))
    )
    res = res.withColumn("pass_rate", r6("pass_rate"))
    return V.failure_preview(res, samples, outcomes, ("pass",), n_examples=5, n_tests=3)


@register(
    "verify_report",
    _with_results()
    + """,
counts as (select status, count(*) as n from results group by status)
select cast(sum(n) as bigint) as total,
  string_agg(concat(status, '=', cast(n as varchar)), ',' order by status) as status_counts,
  cast(coalesce(sum(case when status in ('pass') then n end), 0) as bigint) as kept,
  'pass' as filter_status
from counts
""",
)
def verify_report(spark, sf_dir):
    _, _, res = _results(spark, sf_dir)
    rep = V.verify_report(res, ("pass",))
    entries = F.map_entries("status_counts")
    return rep.select(
        "total",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("status_counts"),
        "kept",
        F.array_join("filter_status", ",").alias("filter_status"),
    )


@register(
    "verify_results_by_runs",
    oracle_with("fx_run_samples", "fx_run_verdicts")
    + """,
runs as (
  select sample_id, run, count(*) filter (where status = 'success') as passed, bool_or(error_type = 'RUNNER_ERROR') as broken
  from fx_run_verdicts group by 1, 2),
agg as (
  select r.sample_id, count(*) as n_runs, bool_or(broken) as broken, sum(passed)::double / (2 * count(*)) as mean_rate,
    (max(passed) - min(passed)) / 2.0 as spread, string_agg(cast(passed / 2.0::double as varchar), ',' order by run) as rates
  from runs r group by 1)
select s.sample_id, case when not has_solution then 'no_solution' when n_tests = 0 then 'no_tests' when broken then 'error'
    when mean_rate >= 1.0 and spread < 0.1 then 'pass' when mean_rate >= 0.5 then 'partial' when not spread < 0.1 then 'flaky' else 'fail' end as status,
  case when has_solution and n_tests > 0 then case when broken then 0.0 else round(mean_rate, 6) end end::double as pass_rate,
  case when has_solution and n_tests > 0 then not broken and spread < 0.1 end as stable,
  case when has_solution and n_tests > 0 and not broken then rates end as pass_rates
from fx_run_samples s left join agg a on a.sample_id = s.sample_id
""",
)
def verify_results_by_runs(spark, sf_dir):
    """Samples with 3, 4 or 10 runs, some of which the runner could not verify."""
    res = V.verify_results(fixture(spark, sf_dir, "fx_run_samples"), fixture(spark, sf_dir, "fx_run_verdicts"))
    return res.select("sample_id", "status", r6("pass_rate").alias("pass_rate"), "stable", join_doubles(F.col("pass_rates")).alias("pass_rates"))


@register(
    "plan_executions",
    oracle_with("fx_code_samples")
    + """,
fan as (
  select sample_id, solution, t.test_idx, r.run,
    concat('assert solve() == ', cast(n_chars as varchar), '  # ', cast(t.test_idx as varchar)) as test
  from fx_code_samples s, (select unnest(range(0, 64)) as test_idx) t, (select unnest(range(0, 4)) as run) r
  where solution <> '' and t.test_idx < s.n_tests),
keyed as (
  select *, concat('__TESTS_COMPLETED__:', sha256(concat_ws(':', cast(sample_id as varchar), cast(run as varchar), cast(test_idx as varchar)))) as sentinel
  from fan)
select sample_id, cast(run as bigint) as run, cast(test_idx as bigint) as test_idx, sentinel,
  concat('# -*- coding: utf-8 -*-', chr(10), solution, chr(10), chr(10), test, chr(10), chr(10), 'print(''', sentinel, ''')', chr(10)) as script,
  8.0::double as timeout_s
from keyed
""",
)
def plan_executions(spark, sf_dir):
    return V.plan_executions(_code_samples(spark, sf_dir), n_runs=4)


def _code_samples(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_code_samples")
    tests = F.transform(
        F.sequence(F.lit(0), F.col("n_tests") - 1),
        lambda i: F.concat(F.lit("assert solve() == "), F.col("n_chars").cast("string"), F.lit("  # "), i.cast("string")),
    )
    return s.select("sample_id", "solution", F.when(F.col("n_tests") > 0, tests).otherwise(F.array().cast("array<string>")).alias("tests"))


_RESUMED_SQL = (
    oracle_with("fx_code_samples")
    + """
select sample_id, cast(r.run as bigint) as run, cast(t.test_idx as bigint) as test_idx, (n_chars + t.test_idx) % 3 > 0 as ok, cast(1 as bigint) as attempts
from fx_code_samples s, (select unnest(range(0, 64)) as test_idx) t, (select unnest(range(0, 4)) as run) r
where solution <> '' and t.test_idx < s.n_tests
"""
)


def _settled(batches):
    """A runner that reads its verdict off the script: the number compared with and the test's place."""
    for batch in batches:
        numbers = batch["script"].str.extract(r"assert solve\(\) == (\d+)  # (\d+)").astype("int64")
        ok = numbers.sum(axis=1) % 3 > 0
        yield batch.drop(columns=["script", "timeout_s", "script_hash"]).assign(
            ok=ok, returncode=(~ok).astype("int32"), stdout=batch["sentinel"].where(ok, ""), stderr="", timed_out=False, blocked=False, error_type=None
        )


@register("resumed_executions", _RESUMED_SQL)
def resumed_executions(spark, sf_dir):
    """Executions kept in a log: a first run that ends after half of the runs, then the whole plan, which
    executes what the log does not hold; every test has been executed once (E3)."""
    samples = _code_samples(spark, sf_dir)
    log = scratch_dir(spark, "executions")
    V.resume_samples(samples, _settled, log, n_runs=2)
    done = V.resume_samples(samples, _settled, log, n_runs=4)
    attempts = spark.read.parquet(log).groupBy("sample_id", "run", "test_idx").agg(F.count(F.lit(1)).alias("attempts"))
    return done.select("sample_id", "run", "test_idx", "ok").join(attempts, ["sample_id", "run", "test_idx"])


@register(
    "classify_outcomes",
    oracle_with("fx_outcomes")
    + """,
c as (
  select *, regexp_replace(
      array_to_string(list_filter(string_split_regex(coalesce(output, ''), '\\r\\n|[\\n\\r]'),
                                  lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> sentinel), chr(10)),
      '^\\s+|\\s+$', '', 'g') as cleaned
  from fx_outcomes)
select doc_id,
  case when coalesce(blocked, false) then 'error' when coalesce(timed_out, false) then 'error'
       when returncode = 0 and strpos(output, sentinel) > 0 then 'success' else 'error' end as status,
  case when coalesce(blocked, false) then coalesce(nullif(cleaned, ''), 'Security violation')
       when coalesce(timed_out, false) then 'Timeout'
       when returncode = 0 and strpos(output, sentinel) = 0 then 'Program exited before tests completed'
       when returncode = 0 then 'All tests passed'
       when strpos(output, 'AssertionError') > 0 then coalesce(nullif(cleaned, ''), 'Test failed')
       when strpos(output, 'SyntaxError') > 0 then coalesce(nullif(cleaned, ''), 'Syntax error')
       when strpos(output, 'FIREJAIL_NOT_AVAILABLE') > 0 then cleaned
       else coalesce(nullif(cleaned, ''), 'Execution failed') end as message,
  case when coalesce(blocked, false) then 'SECURITY_VIOLATION'
       when coalesce(timed_out, false) then 'TIMEOUT'
       when returncode = 0 and strpos(output, sentinel) = 0 then 'INCOMPLETE_TEST_RUN'
       when returncode = 0 then null
       when strpos(output, 'AssertionError') > 0 then 'ASSERTION_ERROR'
       when strpos(output, 'SyntaxError') > 0 then 'SYNTAX_ERROR'
       when strpos(output, 'FIREJAIL_NOT_AVAILABLE') > 0 then 'FIREJAIL_NOT_AVAILABLE'
       else 'RUNTIME_ERROR' end as error_type
from c
""",
)
def classify_outcomes(spark, sf_dir):
    return V.classify_outcomes(fixture(spark, sf_dir, "fx_outcomes", spread_rows=True), ["doc_id"])

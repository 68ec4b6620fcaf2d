"""Queries that need Python's own parser: extraction, validation, screening, scoring of responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardframe.functions.code import screen_code, screen_message
from rewardframe.operators import reward as RW
from rewardframe.operators import verify as V
from rewardframe.plans.fixtures import FIXTURE_SQL, fixture, oracle_with
from rewardframe.plans.q_data import JSON_TESTS, trim_sql
from rewardframe.plans.registry import r6, register
from rewardframe.session import materialize
from rewardframe.sources import sinks as SK
from rewardframe.streaming import scoring as ST

# what the responses of fx_responses hold, by kind (doc_id % 8)
_CODE_SQL = f"""
fenced as (
  select *, doc_id % 8 as kind, regexp_extract_all(coalesce(response, ''), '(?s)```(?:python)?\\s*(.*?)\\s*```', 1) as m from {{0}}),
coded as (
  select *, case when len(m) > 0 then {trim_sql('m[-1]')} when kind = 3 then {trim_sql('response')} else '' end as code,
    kind not in (0, 4, 5) as has_code, kind in (1, 2, 3, 7) as syntax_valid, kind in (1, 2, 3) as compile_valid
  from fenced)
"""


def _coded(view: str) -> str:
    return oracle_with(view).rstrip() + "," + _CODE_SQL.format(view)


@register("extract_code_fallback", _coded("fx_responses") + "select doc_id, code from coded")
def extract_code_fallback(spark, sf_dir):
    """Full scoring extraction: the last fence, else the whole text when it parses as Python."""
    r = fixture(spark, sf_dir, "fx_responses", spread_rows=True)
    return RW.with_checked_code(r, "response", "code").select("doc_id", "code")


@register(
    "validate_code",
    _coded("fx_responses")
    + """select doc_id, has_code, syntax_valid, compile_valid, cast(length(code) as integer) as code_length,
  case when not has_code then 'empty_or_format' when not syntax_valid then 'syntax' when not compile_valid then 'compile' else 'none' end as failure_reason
from coded""",
)
def validate_code_q(spark, sf_dir):
    """Code of each response, validated: blank, broken, not compilable and good code."""
    prepared = RW.with_checked_code(fixture(spark, sf_dir, "fx_responses", spread_rows=True), "response", "code")
    flags = prepared.select(
        "*", F.lit(1).alias("n_tests"), *[F.lit(None).cast("bigint").alias(c) for c in ("passed_n", "timeouts_n", "runtime_errors_n", "outcomes_n")]
    )
    return flags.select(
        "doc_id", "has_code", "syntax_valid", "compile_valid", F.length("code").alias("code_length"), RW.reason_columns()[0]
    )


_FOUND_SQL = """
found(kind6, ord, kind, name, message) as (values
  (0, 0, 'import', 'os', 'import ''os'' is not allowed'), (0, 1, 'attr', 'os.system', 'call ''os.system(...)'' is not allowed'),
  (0, 2, 'attr', 'os.system', 'call ''os.system(...)'' is not allowed'),
  (1, 0, 'import', 'subprocess', 'import ''subprocess'' is not allowed'), (1, 1, 'attr', 'subprocess.run', 'call ''subprocess.run(...)'' is not allowed'),
  (2, 0, 'from', 'os', 'from ''os'' import ... is not allowed'), (2, 1, 'aliased', 'os', 'use of aliased dangerous module ''os'' is not allowed'),
  (2, 2, 'call', 'open', 'call ''open(...)'' is not allowed'), (3, 0, 'call', 'eval', 'call ''eval(...)'' is not allowed'))
"""


@register(
    "screen_code",
    oracle_with("fx_screen").rstrip() + "," + _FOUND_SQL + """
, firsts as (select kind6, message, min(ord) as ord, count(*) as c from found group by 1, 2),
per as (select kind6, cast(sum(c) as integer) as n, string_agg(message, '; ' order by ord) as message from firsts group by 1)
select doc_id, coalesce(n, 0) as n_violations, message, cast(length(code) as integer) as code_length
from fx_screen left join per on kind6 = doc_id % 6
""",
)
def screen_code_q(spark, sf_dir):
    """Violations per script and their message: distinct texts in first-seen order.
    Clean and unparsable code has none."""
    found = fixture(spark, sf_dir, "fx_screen", spread_rows=True).withColumn("found", screen_code("code"))
    return found.select(
        "doc_id", F.size("found").alias("n_violations"), screen_message("found").alias("message"), F.length("code").alias("code_length")
    )


@register(
    "screen_code_kinds",
    oracle_with("fx_screen").rstrip() + "," + _FOUND_SQL
    + "select kind, name, count(*) as n from fx_screen join found on kind6 = doc_id % 6 group by 1, 2",
)
def screen_code_kinds(spark, sf_dir):
    """Violation counts by kind and name over the whole corpus."""
    code = fixture(spark, sf_dir, "fx_screen", spread_rows=True)
    found = code.select(F.explode(screen_code("code")).alias("f")).select("f.kind", "f.name")
    return found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "screen_code_sql",
    oracle_with("fx_screen").rstrip() + "," + _FOUND_SQL
    + "select kind, name, count(*) as n, count(*) as n_valid from fx_screen join found on kind6 = doc_id % 6 group by 1, 2",
)
def screen_code_sql(spark, sf_dir):
    """The table of violations and the validation by their SQL names, in one statement."""
    from rewardframe.functions.sql import register_all

    register_all(spark)
    statement = """
        select f.kind, f.name, count(*) as n, count_if(c.valid.parses) as n_valid
        from (select code, validate_code(code) as valid from {codes}) c, lateral screen_code_table(c.code) f
        group by f.kind, f.name"""
    return spark.sql(statement, codes=fixture(spark, sf_dir, "fx_screen", spread_rows=True).select("code"))


_SCORED_SQL = (
    _coded("fx_scoring").rstrip() + ",\nfx_tests as (select doc_id, tests_text from fx_scoring),\n" + JSON_TESTS.strip() + """,
s as (select coded.*, len(l) as n_tests from coded join c on c.doc_id = coded.doc_id),
k as (
  select *, case when @crash then 'crash' when not has_code then 'blank' when not syntax_valid then 'syntax'
      when not compile_valid then 'compile' when n_tests = 0 or not @ran then 'none' else 'run' end as cls,
    case when doc_id % 3 = 0 then n_tests when doc_id % 3 = 1 then n_tests // 2 else 0 end as p
  from s)
select doc_id as sample_id,
  round(case cls when 'crash' then -2.0 when 'blank' then -1.5 when 'syntax' then -1.0 when 'compile' then -0.5 when 'none' then 0.2
    else (case when p = 0 then -0.2 else 0.0 end) + p * 2.0::double / n_tests + (case when p = n_tests then 1.0 else 0.0 end) end::double, 6) as reward,
  case when cls in ('crash', 'blank', 'none') then 0.0 else n_tests::double end as total,
  case when cls = 'run' then p::double else 0.0 end as passed,
  case when cls = 'crash' then 0.0 else length(code)::double end as code_length,
  case when cls = 'crash' then 0.0 else has_code::int::double end as has_code,
  case when cls = 'syntax' then 1.0::double else 0.0 end as syntax_error,
  case when cls = 'compile' then 1.0::double else 0.0 end as compile_error
from k
"""
)


def _scored_sql(crash: str, ran: str) -> str:
    return _SCORED_SQL.replace("@crash", crash).replace("@ran", ran)


_SCORED_COLUMNS = ("reward", "total", "passed", "code_length", "has_code", "syntax_error", "compile_error")


def _prepared(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_scoring", spread_rows=True)
    return RW.prepare_responses(rows, "response", "tests_text").withColumnRenamed("doc_id", "sample_id")


@register("reward_score_responses", _scored_sql("false", "false"))
def reward_score_responses(spark, sf_dir):
    """End-to-end scoring of raw responses and test texts (U1 U2): extraction, test parsing,
    validation, then shaping; no outcomes were run, so valid code with tests scores as having
    no execution results (0.2), as the reference does for an empty result list."""
    scored = RW.score(_prepared(spark, sf_dir), None)
    return scored.select("sample_id", *[r6(c).alias(c) for c in _SCORED_COLUMNS])


_CRASH = "compile_valid and n_tests > 0 and doc_id % 32 = 3"


def _outcomes(prepared):
    """One outcome for each planned execution: all tests, half of them or none succeed; for some
    responses the runner itself fails."""
    plan = RW.plan_scoring(prepared).join(prepared.select("sample_id", "n_tests"), "sample_id")
    share = F.when(F.col("sample_id") % 3 == 0, F.col("n_tests")).when(F.col("sample_id") % 3 == 1, F.floor(F.col("n_tests") / 2)).otherwise(0)
    crash = F.col("sample_id") % 32 == 3
    return plan.select(
        "sample_id", "test_idx", F.when(~crash & (F.col("test_idx") < share), "success").otherwise("error").alias("status"),
        F.when(crash, V.RUNNER_ERROR).alias("error_type"),
    )


@register("reward_score_outcomes", _scored_sql(_CRASH, "true"))
def reward_score_outcomes(spark, sf_dir):
    """End-to-end scoring with outcomes (E1 U1); where the runner failed, the crash row (-2.0)."""
    prepared = materialize(_prepared(spark, sf_dir))
    scored = RW.score(prepared, _outcomes(prepared))
    return scored.select("sample_id", *[r6(c).alias(c) for c in _SCORED_COLUMNS])


@register("stream_score_responses", _scored_sql(_CRASH, "true"))
def stream_score_responses(spark, sf_dir):
    """The same over a stream of raw responses, joined to the counts of their outcomes (ST1)."""
    outcomes = materialize(RW.outcome_counts(_outcomes(_prepared(spark, sf_dir))))
    documents = ST.stream_from_files(spark, f"{sf_dir}/documents.parquet")
    responses = spark.sql(FIXTURE_SQL["fx_scoring"], documents=documents)
    prepared = RW.prepare_responses(responses, "response", "tests_text").withColumnRenamed("doc_id", "sample_id")
    out, checkpoint = ST.scratch_for(spark, "stream-responses")
    ST.run_available(RW.score(prepared, outcomes), out, checkpoint, "append")
    return spark.read.parquet(out).select("sample_id", *[r6(c).alias(c) for c in _SCORED_COLUMNS])


@register("stream_score_arrivals", _scored_sql(_CRASH, "true"))
def stream_score_arrivals(spark, sf_dir):
    """Responses and their outcomes as two streams of several files, some outcomes twice, half of either
    before a restart: a reward for each response once its outcomes are in (ST1)."""
    from rewardframe.streaming.arrivals import score_arrivals

    base = SK.scratch_dir(spark, "arrivals")
    prepared = materialize(_prepared(spark, sf_dir))
    flags = prepared.select("sample_id", "has_code", "syntax_valid", "compile_valid", "n_tests", "code_length")
    outcomes = materialize(_outcomes(prepared))
    late = F.pmod(F.xxhash64("sample_id"), F.lit(4))
    for half in (0, 1):
        # responses come in both halves, and so do outcomes, mostly not in that of their response
        flags.where(F.col("sample_id") % 2 == half).repartition(2).write.mode("append").parquet(f"{base}/responses")
        outcomes.where((late < 3) if half else (late >= 2)).repartition(2).write.mode("append").parquet(f"{base}/outcomes")
        streams = [ST.stream_from_files(spark, f"{base}/{x}", max_files_per_trigger=1) for x in ("responses", "outcomes")]
        ST.run_available(score_arrivals(*streams), f"{base}/out", f"{base}/checkpoint", "append")
    return spark.read.parquet(f"{base}/out").select("sample_id", *[r6(c).alias(c) for c in _SCORED_COLUMNS])


@register(
    "plan_scoring",
    _coded("fx_scoring").rstrip() + ",\nfx_tests as (select doc_id, tests_text from fx_scoring),\n" + JSON_TESTS.strip()
    + """
select coded.doc_id as sample_id, cast(t.i - 1 as bigint) as test_idx,
  cast(length(code) + length(c.l[t.i]) + length('# -*- coding: utf-8 -*-') + length('__TESTS_COMPLETED__:') + 64 + 15 as integer) as script_chars
from coded join c on c.doc_id = coded.doc_id, unnest(range(1, len(c.l) + 1)) as t(i)
where compile_valid
""",
)
def plan_scoring(spark, sf_dir):
    """Execution plan of the responses whose code is valid, a row for each test."""
    plan = RW.plan_scoring(materialize(_prepared(spark, sf_dir)))
    return plan.select("sample_id", "test_idx", F.length("script").alias("script_chars"))

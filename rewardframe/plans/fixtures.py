"""Test views derived from the driver's tables.

Each view is one SQL text that runs unchanged in Spark SQL and DuckDB. Base tables appear as
``{name}`` placeholders: on the Spark side they are bound to DataFrames read from the scale-factor
folder (``spark.sql(text, events=df)``); on the oracle side they are the pre-registered views.
Literal braces are doubled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rewardframe.session import spread, table

# SQL of texts that hold a whole document text
_COMMENT = "concat('# ', replace(text, chr(10), concat(chr(10), '# ')))"  # as a Python comment
_JSON = "replace(replace(text, chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"  # in a JSON string
_LITERAL = "replace(text, chr(10), concat(chr(92), 'n'))"  # in a single-quoted Python string (texts hold no quote)
_FENCE = "repeat(chr(96), 3)"


def _lines(*parts: str) -> str:
    """SQL of the parts, each on a line of its own."""
    return "concat(" + ", chr(10), ".join(parts) + ")"


# prose, one fence, two fences, bare code, empty, blank, code that does not parse, code that does
# not compile; the prose parts never parse as Python
_RESPONSE = f"""case cast(doc_id % 8 as int)
  when 0 then concat('No code: ', text)
  when 1 then {_lines("'Plan.'", "text", f"concat({_FENCE}, 'python')", "concat('x = ', cast(n_chars as varchar(20)))", _FENCE, "''")}
  when 2 then {_lines(_FENCE, "'a = 1'", f"concat({_FENCE}, ' then ', {_FENCE}, 'python')", _COMMENT, "concat('b = ', cast(doc_id as varchar(20)))", _FENCE)}
  when 3 then {_lines(_COMMENT, "concat('y = ', cast(doc_id as varchar(20)))")}
  when 4 then '' when 5 then concat(' ', chr(10))
  when 6 then {_lines(f"concat({_FENCE}, 'python')", _COMMENT, "'def f(:'", _FENCE)}
  else {_lines(f"concat({_FENCE}, 'python')", _COMMENT, "'return 1'", _FENCE)} end"""

# every shape of test text that needs no Python literal; the first has more tests than are kept
_TESTS = f"""case cast(doc_id % 5 as int)
  when 0 then concat('["assert a", " assert b ", "assert ', {_JSON}, '", "assert 3", "", "assert 4", "assert 5", "assert 6"]')
  when 1 then '' when 2 then '[]'
  when 3 then concat('{{{{"tests": ["assert c", "', {_JSON}, '"]}}}}') else concat('assert ', text) end"""

FIXTURE_SQL: dict[str, str] = {
    # D3: samples, some lacking a solution or tests
    "fx_samples": """
select distinct cast(floor(event_id/8) as bigint) as sample_id,
  case when cast(floor(event_id/8) as bigint) % 10 = 9 then false else true end as has_solution,
  case when cast(floor(event_id/8) as bigint) % 10 = 8 then 0 else 2 end as n_tests
from {events}
""",
    # 4 runs x 2 tests per sample; every status occurs
    "fx_verdicts": """
select cast(floor(event_id/8) as bigint) as sample_id,
  cast(floor((event_id % 8)/2) as bigint) as run, event_id % 2 as test_idx,
  case when floor(event_id/8) % 4 = 0
         or (floor(event_id/8) % 4 = 1 and event_type <> 'error')
         or (floor(event_id/8) % 4 = 2 and event_type in ('view','click'))
       then 'success' else 'error' end as status,
  case when event_type = 'error' then 'TIMEOUT' else 'ASSERTION_ERROR' end as error_type_if_failed
from {events}
where floor(event_id/8) % 10 < 8
""",
    # One row per branch of the outcome classifier, with texts as output and every line end
    "fx_outcomes": f"""
select doc_id, concat('__TESTS_COMPLETED__:', cast(doc_id as varchar(20))) as sentinel,
  case when doc_id % 8 in (0, 1) then 0 when doc_id % 8 in (2, 3, 6) then null else 1 end as returncode,
  doc_id % 8 = 2 as timed_out, doc_id % 8 = 3 as blocked,
  case cast(doc_id % 8 as int)
    when 0 then {_lines("text", "concat('__TESTS_COMPLETED__:', cast(doc_id as varchar(20)))", "''")}
    when 1 then text when 2 then concat('TIMEOUT ', text) when 3 then concat('SECURITY_VIOLATION: ', text)
    when 4 then concat('AssertionError', chr(13), '__TESTS_COMPLETED__:', cast(doc_id as varchar(20)), chr(13), chr(10), text)
    when 5 then concat('SyntaxError: ', text) when 6 then concat('FIREJAIL_NOT_AVAILABLE: ', text) else '' end as output
from {{documents}}
""",
    # model responses of every kind
    "fx_responses": f"select doc_id, n_chars, {_RESPONSE} as response from {{documents}}",
    "fx_tests": f"select doc_id, {_TESTS} as tests_text from {{documents}}",
    # null, blank and present alias columns
    "fx_aliases": """
select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '   ' else concat('p', text) end as prompt,
  case when doc_id % 2 = 0 then '' else concat('q', text) end as problem, text as description
from {documents}
""",
    # user turn with the assistant turn that follows it; some instructions are blank
    "fx_sft": """
select u.conv_id, u.turn, case when u.conv_id % 9 = 4 then ' ' else u.text end as instruction, a.text as output
from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
""",
    # 4 rollouts per prompt
    "fx_rollouts": """
select cast(floor(event_id/4) as bigint) as prompt_id, event_id % 4 as sample_idx, value as reward,
  event_type <> 'error' as runnable, event_type in ('view','click','purchase') as passed,
  concat(event_type, ' ', props, ' ', event_type) as response
from {events}
""",
    # lang = benchmark, source = model path; some pairs are missing
    "fx_bench": """
select d.lang as name, concat('org/', d.source) as model_name, min(d.doc_id) as seq,
  round(avg(cast(l.quality as double)), 6) as pass_at_1
from {documents} d join {labels} l on l.doc_id = d.doc_id
group by d.lang, d.source
""",
    # train loss rows and eval loss rows in one table
    "fx_metric_log": """
select event_id as step, case when event_id % 10 <> 0 then value end as loss,
  case when event_id % 10 = 0 then value end as eval_loss
from {events}
""",
    # evaluator output text with exit code
    "fx_eval_log": """
select doc_id, case when doc_id % 7 = 0 then 1 else 0 end as exit_code,
  case when doc_id % 5 = 0 then 'no score' else concat('humaneval (base tests)', chr(10), 'pass@1:', chr(9), '0.', cast(n_chars % 900 + 100 as varchar(20)), chr(10),
  'humaneval+ (base + extra tests)', chr(10), 'pass@1:', chr(9), '0.', cast(n_chars % 800 + 100 as varchar(20)), chr(10)) end as log
from {documents}
""",
    # raw samples of mixed aliases: prompt/problem/description, code as the solution alias, test text
    "fx_raw": f"""
select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '   ' else concat('p', text) end as prompt,
  case when doc_id % 2 = 0 then '' else concat('q', text) end as problem, text as description,
  case when doc_id % 4 = 0 then '' else {_lines("'def f():'", "concat('    return ', cast(doc_id as varchar(20)))")} end as code,
  {_TESTS} as tests, lang
from {{documents}}
""",
    # responses and test texts of the same documents in one scan (fx_responses + fx_tests)
    "fx_scoring": f"select doc_id, n_chars, {_RESPONSE} as response, {_TESTS} as tests_text from {{documents}}",
    # HumanEval-style test programs: 0..7 assert lines among other lines
    "fx_he_tests": f"""
select doc_id, concat('def check(c):', chr(10), {_COMMENT}, chr(10),
  repeat(concat('    assert c(', cast(doc_id as varchar(20)), ') == 1', chr(10), '    x = 1', chr(10)), cast(doc_id % 8 as int)),
  '  pass', chr(10)) as test
from {{documents}}
""",
    # code to screen: banned imports, aliased modules, banned calls, code that does not parse, clean code
    "fx_screen": f"""
select doc_id, concat({_COMMENT}, chr(10), case cast(doc_id % 6 as int)
  when 0 then concat('import os', chr(10), 'os.system(', chr(39), 'ls', chr(39), ')', chr(10), 'os.system(', chr(39), 'ls', chr(39), ')')
  when 1 then concat('import subprocess as sp', chr(10), 'sp.run([', chr(39), 'x', chr(39), '])')
  when 2 then concat('from os import path as p', chr(10), 'p(1)', chr(10), 'data = open(', chr(39), 'f', chr(39), ')')
  when 3 then concat('x = eval(', chr(39), cast(doc_id as varchar(20)), chr(39), ')')
  when 4 then concat('import os', chr(10), 'def f(:')
  else concat('print(', cast(doc_id as varchar(20)), ')') end) as code
from {{documents}}
""",
    # test lists written as Python literals (single quotes, adjacent strings, tuples, no literal)
    "fx_literal_tests": f"""
select doc_id, text, {_LITERAL} as literal, case cast(doc_id % 4 as int)
  when 0 then concat('[', chr(39), 'assert f(', cast(doc_id as varchar(20)), ')', chr(39), ', ', chr(39), {_LITERAL}, chr(39), ']')
  when 1 then concat('[', chr(39), 'assert a', chr(39), ' ', chr(39), {_LITERAL}, chr(39), ']')
  when 2 then concat('(', chr(39), {_LITERAL}, chr(39), ',)')
  else concat('[x ', cast(doc_id as varchar(20)), ' ', replace(text, chr(34), ' '), ']') end as tests_text
from {{documents}}
""",
    # 3, 4 or 10 runs of 2 tests for each sample; runs of one kind never pass, some fail early
    "fx_run_samples": """
select distinct cast(floor(event_id/20) as bigint) as sample_id,
  floor(event_id/20) % 10 <> 9 as has_solution, case when floor(event_id/20) % 10 = 8 then 0 else 2 end as n_tests
from {events}
""",
    "fx_run_verdicts": """
select sample_id, run, test_idx,
  case when sample_id % 5 = 0 or (sample_id % 5 = 1 and run >= 6) or (sample_id % 5 = 2 and event_type <> 'error') then 'success' else 'error' end as status,
  case when sample_id % 25 = 4 then 'RUNNER_ERROR' else 'ASSERTION_ERROR' end as error_type
from (select cast(floor(event_id/20) as bigint) as sample_id, cast(floor((event_id % 20)/2) as bigint) as run, event_id % 2 as test_idx, event_type from {events}) e
where run < case cast(sample_id % 3 as int) when 0 then 3 when 1 then 4 else 10 end
""",
    # samples with code and tests made of whole texts
    "fx_code_samples": f"""
select doc_id as sample_id, case when doc_id % 10 = 9 then '' when doc_id % 10 = 7 then ' ' else {_lines(_COMMENT, "'def solve():'", "concat('    return ', cast(n_chars as varchar(20)))")} end as solution,
  case when doc_id % 10 = 8 then 0 else 1 + doc_id % 3 end as n_tests, n_chars
from {{documents}}
""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def base_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def fixture(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    """The fixture view as a Spark DataFrame over the parquet tables of ``sf_dir``; with
    ``spread_rows`` the rows are spread for CPU-heavy work (see ``session.spread``)."""
    frames = {t: table(spark, sf_dir, t) for t in base_tables(name)}
    df = spark.sql(FIXTURE_SQL[name], **frames)
    return spread(df) if spread_rows else df


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining the given fixture views over DuckDB's pre-registered tables."""
    parts = []
    for n in names:
        text = FIXTURE_SQL[n].format(**{t: t for t in base_tables(n)})
        parts.append(f"{n} as ({text.strip()})")
    return "with " + ",\n".join(parts) + "\n"

"""Text, preparation, sampling, evaluation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardframe.functions import text as TX
from rewardframe.functions.tests_parse import with_tests
from rewardframe.functions.tokens import DEFAULT_TOKEN_PATTERN, count_tokens
from rewardframe.operators import convert as CV
from rewardframe.operators import evaluation as EV
from rewardframe.operators import profile as PF
from rewardframe.operators import sampling as SM
from rewardframe.plans.fixtures import fixture, oracle_with
from rewardframe.plans.registry import r6, register
from rewardframe.session import spread, table

TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trim_sql(x: str) -> str:
    return TRIM.format(x=x)


# ----------------------------------------------------------------------------- code extraction

@register(
    "extract_code_last",
    oracle_with("fx_responses")
    + f"""
select doc_id, len(m) > 0 as has_fence, case when len(m) > 0 then {trim_sql('m[-1]')} end as code
from (select doc_id, regexp_extract_all(coalesce(response, ''), '(?s)```(?:python)?\\s*(.*?)\\s*```', 1) as m from fx_responses)
""",
)
def extract_code_last(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_responses", spread_rows=True)
    return r.select("doc_id", TX.has_fence("response").alias("has_fence"), TX.fence_last("response").alias("code"))


@register(
    "extract_code_first",
    oracle_with("fx_responses")
    + f"""
select doc_id, case when len(p) > 0 then {trim_sql('p[1]')} when len(q) > 0 then {trim_sql('q[1]')} else response end as code
from (select doc_id, response,
        regexp_extract_all(response, '(?s)```python\\n(.*?)```', 1) as p,
        regexp_extract_all(response, '(?s)```\\n(.*?)```', 1) as q from fx_responses)
""",
)
def extract_code_first(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_responses", spread_rows=True)
    return r.select("doc_id", TX.fence_first("response").alias("code"))


# ----------------------------------------------------------------------------- tests parsing

JSON_TESTS = f"""
t as (select doc_id, {trim_sql('coalesce(tests_text, \'\')')} as s from fx_tests),
p as (
  select doc_id, case
    when s = '' then []::varchar[]
    when not json_valid(s) then [s]
    when json_type(s::json) = 'ARRAY' then json_extract_string(s, '$[*]')
    when json_type(s::json) = 'VARCHAR' then [json_extract_string(s, '$')]
    when json_type(s::json) = 'OBJECT' then coalesce(
      case when json_exists(s, '$.test') then json_extract_string(s, '$.test[*]') end,
      case when json_exists(s, '$.tests') then json_extract_string(s, '$.tests[*]') end,
      case when json_exists(s, '$.test_cases') then json_extract_string(s, '$.test_cases[*]') end,
      case when json_exists(s, '$.assertion') then json_extract_string(s, '$.assertion[*]') end,
      case when json_exists(s, '$.check') then json_extract_string(s, '$.check[*]') end)
    else []::varchar[] end as l
  from t),
c as (select doc_id, list_filter(list_transform(l, lambda x: {trim_sql('x')}), lambda x: x <> '') as l from p)
"""


@register(
    "parse_tests_json",
    oracle_with("fx_tests").rstrip() + ",\n" + JSON_TESTS.strip()
    + """
select doc_id, cast(len(l) as integer) as n_tests, array_to_string(l, '|') as tests, array_to_string(l[1:5], '|') as first5
from c
""",
)
def parse_tests_json(spark, sf_dir):
    t = with_tests(fixture(spark, sf_dir, "fx_tests", spread_rows=True), "tests_text", "tests")
    return t.select(
        "doc_id", F.size("tests").alias("n_tests"), F.array_join("tests", "|").alias("tests"),
        F.array_join(EV.mbpp_tests("tests"), "|").alias("first5"),
    )


@register(
    "parse_tests_literal",
    oracle_with("fx_literal_tests")
    + """
select doc_id, case cast(doc_id % 4 as int) when 0 then concat('assert f(', cast(doc_id as varchar), ')|', text)
    when 1 then concat('assert a', text) when 2 then tests_text else '' end as tests,
  case cast(doc_id % 4 as int) when 0 then concat('assert f(', cast(doc_id as varchar), ')|', text)
    when 1 then concat('assert a|', text) when 2 then tests_text else '' end as tests_split_adjacent
from fx_literal_tests
""",
)
def parse_tests_literal(spark, sf_dir):
    """Test lists written as Python literals, adjacent strings joined or kept apart."""
    t = fixture(spark, sf_dir, "fx_literal_tests", spread_rows=True)
    t = with_tests(with_tests(t, "tests_text", "t1"), "tests_text", "t2", split_adjacent=True)
    return t.select("doc_id", F.array_join("t1", "|").alias("tests"), F.array_join("t2", "|").alias("tests_split_adjacent"))


@register(
    "assert_lines",
    oracle_with("fx_he_tests")
    + f"""
, a as (select doc_id, list_filter(list_transform(string_split(test, chr(10)), lambda x: {trim_sql('x')}), lambda x: starts_with(x, 'assert ')) as l from fx_he_tests)
select doc_id, cast(len(l) as integer) as n_all, cast(len(l[1:5]) as integer) as n_kept, array_to_string(l[1:5], '|') as tests
from a where len(l) > 0
""",
)
def assert_lines(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_he_tests", spread_rows=True)
    all_ = TX.assert_lines("test", 1 << 30)
    out = t.select("doc_id", all_.alias("all_tests"), EV.humaneval_tests("test").alias("tests"))
    return EV.with_tests_only(out, "tests").select(
        "doc_id", F.size("all_tests").alias("n_all"), F.size("tests").alias("n_kept"), F.array_join("tests", "|").alias("tests")
    )


# ----------------------------------------------------------------------------- aliases and records

_FNE = "case when {c} is not null and {t} <> '' then {c} end"


@register(
    "first_non_empty",
    oracle_with("fx_aliases")
    + "select doc_id, coalesce("
    + ", ".join(_FNE.format(c=c, t=trim_sql(c)) for c in ("prompt", "problem", "description"))
    + ", '') as prompt_text from fx_aliases",
)
def first_non_empty(spark, sf_dir):
    a = fixture(spark, sf_dir, "fx_aliases", spread_rows=True)
    return a.select("doc_id", TX.first_non_empty(a.schema, TX.PROMPT_ALIASES, default="").alias("prompt_text"))


@register(
    "truthy_fallback",
    oracle_with("fx_aliases")
    + "select doc_id, coalesce(nullif(prompt, ''), nullif(problem, ''), description, '') as text from fx_aliases",
)
def truthy_fallback(spark, sf_dir):
    a = fixture(spark, sf_dir, "fx_aliases", spread_rows=True)
    return a.select("doc_id", TX.truthy_first("prompt", "problem", "description").alias("text"))


def _records(spark, sf_dir, with_index: bool = True):
    if not with_index:
        raw = fixture(spark, sf_dir, "fx_raw", spread_rows=True)
        return CV.training_records(raw.withColumn("_row", F.lit(None).cast("bigint")), "_row")
    # the index's bucket exchange already spreads the rows for the parsing that follows
    indexed = SM.dense_index(fixture(spark, sf_dir, "fx_raw"), "doc_id", "_row")
    return CV.training_records(indexed, "_row")


_RECORDS_SQL = (
    oracle_with("fx_raw").replace("fx_raw as", "fx_raw0 as", 1).rstrip()
    + ",\nfx_tests as (select doc_id, tests as tests_text from fx_raw0),\n"
    + JSON_TESTS.strip()
    + f""",
r as (
  select f.*, c.l as tl, row_number() over (order by f.doc_id) - 1 as idx,
    coalesce({_FNE.format(c='f.prompt', t=trim_sql('f.prompt'))}, {_FNE.format(c='f.problem', t=trim_sql('f.problem'))},
             {_FNE.format(c='f.description', t=trim_sql('f.description'))}, '') as prompt_text,
    coalesce({_FNE.format(c='f.code', t=trim_sql('f.code'))}, '') as sol
  from fx_raw0 f join c on c.doc_id = f.doc_id)
"""
)


@register(
    "training_record",
    _RECORDS_SQL
    + """
select prompt_text as prompt, 'custom' as data_source, 'code_generation' as ability, 'code_execution' as style,
  array_to_string(tl, '|') as ground_truth, cast(idx as bigint) as "index", 'train' as split,
  array_to_string(tl, '|') as tests, sol as solution, 'description,doc_id,lang' as extra_keys,
  cast(doc_id as varchar) as extra_doc_id, cast(to_json(lang) as varchar) as extra_lang
from r
""",
)
def training_record(spark, sf_dir):
    rec = _records(spark, sf_dir)
    return rec.select(
        "prompt", "data_source", "ability", F.col("reward_model.style").alias("style"),
        F.array_join("reward_model.ground_truth", "|").alias("ground_truth"),
        F.col("extra_info.index").alias("index"), F.col("extra_info.split").alias("split"),
        F.array_join("extra_info.tests", "|").alias("tests"), F.col("extra_info.solution").alias("solution"),
        F.array_join(F.array_sort(F.map_keys("extra_info.extra")), ",").alias("extra_keys"),
        F.col("extra_info.extra").getItem("doc_id").alias("extra_doc_id"),
        F.col("extra_info.extra").getItem("lang").alias("extra_lang"),
    )


@register(
    "conversion_report",
    _RECORDS_SQL
    + """
select count(*) as total, count(*) filter (where sol <> '') as with_solution,
  round(count(*) filter (where sol <> '') * 100.0 / count(*), 6)::double as with_solution_pct,
  round(avg(len(tl))::double, 6) as avg_tests
from r
""",
)
def conversion_report(spark, sf_dir):
    rep = CV.conversion_report(_records(spark, sf_dir, with_index=False))
    return rep.select("total", "with_solution", r6("with_solution_pct").alias("with_solution_pct"), r6("avg_tests").alias("avg_tests"))


# ----------------------------------------------------------------------------- chat and tokens

_SYS = CV.DEFAULT_SYSTEM_PROMPT
_RENDER_SQL = (
    "concat('<|system|>', chr(10), '" + _SYS + "', chr(10), '<|user|>', chr(10), coalesce(instruction, ''), chr(10), "
    "'<|assistant|>', chr(10), coalesce(output, ''), chr(10), '<|assistant|>', chr(10))"
)


def _tok_sql(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '{DEFAULT_TOKEN_PATTERN}')) as bigint)"


@register(
    "chat_messages",
    oracle_with("fx_sft")
    + f"""
select conv_id, turn, 'system,user,assistant' as roles,
  cast({len(_SYS)} + length(instruction) + length(output) as integer) as content_chars
from fx_sft
""",
)
def chat_messages(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_sft").withColumn("messages", CV.sft_messages("instruction", "output"))
    return s.select(
        "conv_id", "turn",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.length(m["content"])).alias("content_chars"),
    )


@register(
    "chat_render",
    oracle_with("fx_sft") + f"select conv_id, turn, {_tok_sql(_RENDER_SQL)} as n_tokens from fx_sft",
)
def chat_render(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_sft").withColumn("messages", CV.sft_messages("instruction", "output"))
    return s.select("conv_id", "turn", CV.message_tokens("messages").alias("n_tokens"))


@register(
    "conversation_tokens",
    f"""
select conv_id, count(*) as n_turns,
  cast(sum({_tok_sql("concat('<|', role, '|>', chr(10), coalesce(text, ''), chr(10))")}) + {_tok_sql("concat('<|assistant|>', chr(10))")} as bigint) as n_tokens
from conversations group by conv_id
""",
)
def conversation_tokens(spark, sf_dir):
    return CV.turn_token_counts(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_tokens")


_USER_RENDER = "concat('<|user|>', chr(10), coalesce(text, ''), chr(10), '<|assistant|>', chr(10))"


@register(
    "token_filter",
    f"select doc_id, n from (select doc_id, {_tok_sql(_USER_RENDER)} as n from documents) where n <= 500",
)
def token_filter(spark, sf_dir):
    """Documents whose text, rendered as one user message with the generation prompt, has at
    most 500 tokens (F4)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return CV.within_tokens(d, "text", 500, out="n").select("doc_id", "n")


@register(
    "token_describe",
    f"""
select count(n) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n)::double as min,
  round(quantile_cont(n, 0.25), 6) as p25, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.75), 6) as p75,
  max(n)::double as max
from (select {_tok_sql('text')} as n from documents)
""",
)
def token_describe(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select(count_tokens("text").alias("n"))
    desc = PF.describe(d, "n")
    return desc.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register(
    "value_describe",
    """
select count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min,
  round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75,
  max(value) as max
from events
""",
)
def value_describe(spark, sf_dir):
    """Description of a column with as many values as rows: exact quartiles by rank search."""
    desc = PF.describe_values(table(spark, sf_dir, "events"), "value")
    return desc.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


_PT = f"""case when (conv_id + turn) % 5 = 0 then cast(0 as bigint) else {_tok_sql(_RENDER_SQL)} end"""


@register(
    "prompt_token_describe",
    oracle_with("fx_sft")
    + f"""
select count(n) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n)::double as min,
  round(quantile_cont(n, 0.25), 6) as p25, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.75), 6) as p75,
  max(n)::double as max
from (select {_PT} as n from fx_sft)
""",
)
def prompt_token_describe(spark, sf_dir):
    """Prompts stored as JSON message text (every fifth one plain text, which counts 0), token
    counts by ``prompt_tokens``, described (P9 statistics variant, A7)."""
    s = fixture(spark, sf_dir, "fx_sft")
    as_json = F.to_json(CV.sft_messages("instruction", "output"))
    prompt = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.col("instruction")).otherwise(as_json)
    d = s.select(CV.prompt_tokens(prompt).alias("n"))
    desc = PF.describe(d, "n")
    return desc.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


# ----------------------------------------------------------------------------- SFT filtering and sampling

_REASON_SQL = """case when {b_i} or {b_o} then 'empty'
  when length(instruction) + length(output) > 1200 then 'too_long'
  when length(output) < 200 then 'too_short' else 'accepted' end"""


def _reason_sql() -> str:
    def blank(c):
        return f"({c} is null or {trim_sql(c)} = '')"

    return _REASON_SQL.format(b_i=blank("instruction"), b_o=blank("output"))


def _sft(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_sft")
    return s.withColumn("reason", SM.sft_reason("instruction", "output", 1200, 200)).withColumn(
        "sid", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )


_SFT_K = (
    oracle_with("fx_sft")
    + f""", k as (select *, {_reason_sql()} as reason, concat(cast(conv_id as varchar), ':', cast(turn as varchar)) as sid
  from fx_sft),
kk as (select *, md5(concat('42:', sid)) as key from k),
acc as (select *, row_number() over (order by key, sid) as rn from kk where reason = 'accepted'),
cut as (select key as ck, sid as ct from acc where rn = 100)
"""
)


@register(
    "sft_filter",
    oracle_with("fx_sft")
    + f"""select conv_id, turn, cast(length(instruction) + length(output) as integer) as total_chars
from fx_sft where {_reason_sql()} = 'accepted'""",
)
def sft_filter(spark, sf_dir):
    s = _sft(spark, sf_dir)
    return s.where(F.col("reason") == "accepted").select(
        "conv_id", "turn", (F.length("instruction") + F.length("output")).alias("total_chars")
    )


@register(
    "sft_funnel",
    oracle_with("fx_sft") + f"select {_reason_sql()} as reason, count(*) as n from fx_sft group by 1",
)
def sft_funnel(spark, sf_dir):
    return _sft(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("sft_sample", _SFT_K + "select conv_id, turn from acc where rn <= 100")
def sft_sample(spark, sf_dir):
    acc, _ = SM.sample_accepted(_sft(spark, sf_dir), "reason", "sid", 100)
    return acc.select("conv_id", "turn")


@register(
    "sft_sample_funnel",
    _SFT_K
    + """select reason, count(*) as n from kk
where (select count(*) from cut) = 0 or key < (select ck from cut) or (key = (select ck from cut) and sid <= (select ct from cut))
group by reason""",
)
def sft_sample_funnel(spark, sf_dir):
    _, funnel = SM.sample_accepted(_sft(spark, sf_dir), "reason", "sid", 100)
    return funnel


_SPLIT = """
with k as (select *, md5(concat('42:', cast(doc_id as varchar))) as key from documents),
r as (select *, row_number() over (order by key, doc_id) as rn, count(*) over () as total from k)
"""
_DOC = "doc_id, text, lang, source, n_chars"


@register("split_train", _SPLIT + f"select {_DOC} from r where rn <= floor(total * 0.95)")
def split_train(spark, sf_dir):
    train, _ = SM.split_exact(table(spark, sf_dir, "documents"), "doc_id", 0.95, 42)
    return train


@register("split_val", _SPLIT + f"select {_DOC} from r where rn > floor(total * 0.95)")
def split_val(spark, sf_dir):
    _, val = SM.split_exact(table(spark, sf_dir, "documents"), "doc_id", 0.95, 42)
    return val


@register(
    "split_repeated_ids",
    """
with g as (select case when doc_id % 3 > 0 then doc_id // 64 end as id, count(*) as n, sum(length(coalesce(text, ''))) as chars from documents group by 1),
c as (select *, sum(n) over (order by coalesce(md5('42:' || cast(id as varchar)), '')) - n as before, cast(floor(sum(n) over () * 0.55) as bigint) as total from g)
select id, cast(greatest(0, least(n, total - before)) as bigint) as n_train, cast(n - greatest(0, least(n, total - before)) as bigint) as n_val,
  cast(chars as bigint) as chars
from c
""",
)
def split_repeated_ids(spark, sf_dir):
    """An exact split where ids stand for many rows and a third of all rows have none: how many rows of
    each id are on either side, and their characters (L5)."""
    ids = F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 64)).alias("id")
    train, val = SM.split_exact(table(spark, sf_dir, "documents").select(ids, "text"), "id", 0.55, 42)
    both = train.select("id", "text", F.lit(1).alias("t")).unionByName(val.select("id", "text", F.lit(0).alias("t")))
    return both.groupBy("id").agg(
        F.count_if(F.col("t") == 1).alias("n_train"), F.count_if(F.col("t") == 0).alias("n_val"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"),
    )


@register("seeded_shuffle_rank", _SPLIT + f"select {_DOC}, cast(rn - 1 as bigint) as rank from r")
def seeded_shuffle_rank(spark, sf_dir):
    """The whole table in the seeded order, as the jobs write it, with each row's place (L3)."""
    shuffled = SM.in_seeded_order(table(spark, sf_dir, "documents"), "doc_id", 42)
    return SM.dense_index(shuffled.withColumn("_place", F.monotonically_increasing_id()), "_place", "rank").drop("_place")


@register(
    "seeded_shuffle_head",
    f"select {_DOC} from documents order by md5(concat('42:', cast(doc_id as varchar))), doc_id limit 100",
)
def seeded_shuffle_head(spark, sf_dir):
    """The first 100 rows of the seeded order (the limit is the feature)."""
    return SM.first_n_by_key(table(spark, sf_dir, "documents"), 100, "doc_id", 42)


@register(
    "position_ids",
    """select coalesce(case when doc_id % 2 = 0 then concat('d', cast(doc_id as varchar)) end,
  cast(row_number() over (order by doc_id) - 1 as varchar)) as id, doc_id, text from documents""",
)
def position_ids(spark, sf_dir):
    """Missing ids become the row's position as text (P25)."""
    d = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"), "doc_id", "text"
    )
    return SM.with_position_id(d, "id", "doc_id")


# ----------------------------------------------------------------------------- profile

@register(
    "preview",
    """select doc_id, lang, source, n_chars,
  case when length(text) > 300 then concat(substr(text, 1, 300), '...') else text end as text_preview
from documents order by doc_id limit 5""",
)
def preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return PF.head_preview(d, "doc_id", "text", 5, 300)


@register(
    "overview",
    "select count(*) as n_rows, cast(5 as bigint) as n_columns, 'doc_id,text,lang,source,n_chars' as columns from documents",
)
def overview(spark, sf_dir):
    return PF.overview(table(spark, sf_dir, "documents"))


# ----------------------------------------------------------------------------- evaluation

@register(
    "pass_at_k",
    oracle_with("fx_rollouts")
    + """, items as (
  select concat('bench', cast(prompt_id % 3 as varchar)) as bench, prompt_id,
    arg_min(passed, sample_idx) as first_passed, bool_or(passed) as any_passed, count(*) as n_generated
  from fx_rollouts group by 1, 2)
select bench, round(avg(first_passed::int::double), 6) as pass_at_1, round(avg(any_passed::int::double), 6) as pass_at_k,
  count(*) as n_samples, max(n_generated) as k
from items group by bench
""",
)
def pass_at_k(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_rollouts").withColumn("bench", F.concat(F.lit("bench"), (F.col("prompt_id") % 3).cast("string")))
    res = EV.pass_at_k(r, "bench", "prompt_id", "sample_idx", "passed")
    return res.select("bench", r6("pass_at_1").alias("pass_at_1"), r6("pass_at_k").alias("pass_at_k"), "n_samples", "k")


_MODELS = ["org/src3", "org/src4", "org/src7"]


def _cell(m: str) -> str:
    return (
        f"coalesce(cast(round(arg_min(pass_at_1, seq) filter (where model_name = '{m}') * 100, 1) as varchar) || '%', 'N/A') as \"{m}\""
    )


@register(
    "benchmark_compare",
    oracle_with("fx_bench") + "select name, " + ", ".join(_cell(m) for m in _MODELS) + " from fx_bench group by name",
)
def benchmark_compare(spark, sf_dir):
    return EV.compare_models(fixture(spark, sf_dir, "fx_bench"), _MODELS)


@register(
    "benchmark_summary",
    oracle_with("fx_bench")
    + """select regexp_extract(model_name, '[^/]*$') as model, name as benchmark,
  concat(cast(round(pass_at_1 * 100, 1) as varchar), '%') as pass_at_1,
  concat(cast(round(pass_at_1 * 100, 1) as varchar), '%') as pass_at_k,
  '0.00' as temp
from fx_bench""",
)
def benchmark_summary(spark, sf_dir):
    """Formatted summary of benchmark results (K8 P26 P27); greedy runs: pass@k = pass@1, temperature 0."""
    b = fixture(spark, sf_dir, "fx_bench").withColumn("pass_at_k", F.col("pass_at_1")).withColumn("temperature", F.lit(0.0))
    return EV.benchmark_summary(b)


_LOG_SQL = """coalesce(nullif(string_split_regex(regexp_replace(list_filter(flatten(list_transform(
    list_filter(range(1, len(string_split(coalesce(log, ''), chr(10))) + 1), lambda i: strpos(string_split(coalesce(log, ''), chr(10))[i], '{m}') > 0),
    lambda i: [string_split(coalesce(log, ''), chr(10))[i], string_split(coalesce(log, ''), chr(10))[i + 1]])),
    lambda s: strpos(lower(s), 'pass@') > 0)[1], '^[ \\t]+', ''), '[ \\t]+')[2], ''), 'N/A')"""


@register(
    "eval_log_scores",
    oracle_with("fx_eval_log")
    + "select doc_id, case when exit_code <> 0 then 'Error' else "
    + _LOG_SQL.format(m="(base tests)")
    + " end as base_score, case when exit_code <> 0 then 'Error' else "
    + _LOG_SQL.format(m="(base + extra tests)")
    + " end as plus_score from fx_eval_log",
)
def eval_log_scores(spark, sf_dir):
    return EV.eval_log_scores(fixture(spark, sf_dir, "fx_eval_log", spread_rows=True), keep=["doc_id"])


_LOG_RUNS = """
with g as (select source as model, lang as benchmark, count(*) as n, max(doc_id) as last from documents where source is not null and lang is not null group by 1, 2),
codes as (select model, benchmark, case when last % 7 = 3 then 1 else 0 end as exit_code from g
  union all select model, 'lost', 0 from g group by model)
"""


@register(
    "eval_log_files",
    _LOG_RUNS
    + """
select c.model, c.benchmark,
  case when c.exit_code <> 0 then 'Error' else coalesce('0.' || cast(g.n as varchar), 'N/A') end as base_score,
  case when c.exit_code <> 0 then 'Error' when g.n is null or g.last % 5 = 1 then 'N/A' else concat('0.', cast(g.last as varchar)) end as plus_score
from codes c left join g on g.model = c.model and g.benchmark = c.benchmark
""",
)
def eval_log_files(spark, sf_dir):
    """Log files of models and benchmarks, with all documents as their chatter, read as a source; exit
    codes from a table, one run without a log (S8)."""
    from rewardframe.sources.logs import read_eval_logs
    from rewardframe.sources.sinks import scratch_dir

    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    group = ["source", "lang"]
    sums = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    text = F.coalesce("text", F.lit(""))
    ends = F.concat(
        F.lit("\nx (base tests)\n\tPass@1: 0."), F.col("n").cast("string"), F.lit("\npass@9 9.9\nx (base + extra tests)\n"),
        F.when(F.col("last") % 5 == 1, "nothing").otherwise(F.concat(F.lit("  pass@1 0."), F.col("last").cast("string"))),
    )
    lines = d.join(sums, group).select(*group, F.when(F.col("doc_id") == F.col("last"), F.concat(text, ends)).otherwise(text).alias("value"))
    out = scratch_dir(spark, "logs")
    lines.select(F.col("source").alias("model"), F.col("lang").alias("benchmark"), "value").repartition("model", "benchmark", F.length("value") % 2).write.partitionBy("model", "benchmark").text(out)
    codes = sums.select(F.col("source").alias("model"), F.col("lang").alias("benchmark"), F.when(F.col("last") % 7 == 3, 1).otherwise(0).alias("exit_code"))
    codes = codes.unionByName(sums.select(F.col("source").alias("model"), F.lit("lost").alias("benchmark"), F.lit(0).alias("exit_code")).distinct())
    return read_eval_logs(spark, out, codes, pattern=r"model=([^/]+)/benchmark=([^/]+)/[^/]+$")


@register(
    "metric_series",
    oracle_with("fx_metric_log")
    + """select 'loss' as series, step, round(loss, 6) as value from fx_metric_log where loss is not null
union all select 'eval_loss', step, round(eval_loss, 6) from fx_metric_log where eval_loss is not null""",
)
def metric_series(spark, sf_dir):
    s = EV.metric_series(fixture(spark, sf_dir, "fx_metric_log"))
    return s.select("series", "step", r6("value").alias("value"))


@register(
    "rollout_metrics",
    oracle_with("fx_rollouts")
    + """select prompt_id, round(avg(reward), 6) as reward_mean, round(stddev_pop(reward), 6) as reward_std,
  round(avg(passed::int::double), 6) as pass_rate, round(avg(runnable::int::double), 6) as runnable_rate,
  stddev_pop(reward) < 1e-6 as is_degenerate, count(*) as n
from fx_rollouts group by prompt_id""",
)
def rollout_metrics(spark, sf_dir):
    m = EV.rollout_metrics(fixture(spark, sf_dir, "fx_rollouts"))
    return m.select("prompt_id", *[r6(c).alias(c) for c in ("reward_mean", "reward_std", "pass_rate", "runnable_rate")], "is_degenerate", "n")


@register(
    "rollout_diversity",
    oracle_with("fx_rollouts")
    + f""", w as (select prompt_id, string_split_regex({trim_sql('response')}, '\\s+') as ws from fx_rollouts),
b as (select prompt_id, unnest(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) else [NULL] end) as bigram from w)
select prompt_id, count(distinct bigram) as n_distinct, count(bigram) as n_bigrams,
  round(coalesce(count(distinct bigram)::double / nullif(count(bigram), 0), 0.0), 6) as distinct_2
from b group by prompt_id""",
)
def rollout_diversity(spark, sf_dir):
    d = EV.distinct_2(fixture(spark, sf_dir, "fx_rollouts", spread_rows=True))
    return d.select("prompt_id", "n_distinct", "n_bigrams", r6("distinct_2").alias("distinct_2"))

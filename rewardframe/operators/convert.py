"""Training records, conversion report, chat messages and token counts.

Schema-on-read: the alias lists are resolved at plan time against the input's schema, so the
converter is one projection (no per-row Python) over any Parquet/JSON input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardframe.functions.tests_parse import with_tests
from rewardframe.functions.text import (
    PROMPT_ALIASES,
    SOLUTION_ALIASES,
    TESTS_ALIASES,
    alias_type,
    as_variant,
    col_,
    first_non_empty,
    first_text,
    render_messages,
    variant_text,
)
from rewardframe.functions.tokens import count_tokens

# Fixed values that must equal the reference's for equal results.
REWARD_STYLE = "code_execution"
DEFAULT_DATA_SOURCE = "custom"
DEFAULT_ABILITY = "code_generation"
DEFAULT_SPLIT = "train"
# input keys never copied into extra_info
CONSUMED_KEYS = ["prompt", "solution", "tests", "problem", "code", "answer"]
DEFAULT_SYSTEM_PROMPT = "You are a helpful and expert programming assistant."


def _with_tests_value(df: DataFrame, out: str) -> DataFrame:
    """First non-empty tests alias as ``array<string>`` in column ``out``; text, numbers and objects
    are parsed with the tests rules (staged, see ``tests_parse.with_tests``); lists of strings are
    kept as they are."""
    present = [n for n in TESTS_ALIASES if n in df.columns]
    none = F.array().cast("array<string>")
    if not present:
        return df.withColumn(out, none)
    dtype, picked = alias_type(df.schema, present), first_non_empty(df.schema, present)
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return df.withColumn(out, F.coalesce(F.transform(picked, lambda x: x.cast("string")), none))
    if isinstance(dtype, T.StringType):
        return with_tests(df.withColumn("_tests_text", picked), "_tests_text", out).drop("_tests_text")
    staged = df.withColumn("_tests_value", as_variant(picked, dtype))
    is_list = F.schema_of_variant("_tests_value") == "ARRAY<STRING>"
    staged = staged.withColumns({
        "_tests_list": F.when(is_list, F.try_variant_get("_tests_value", "$", "array<string>")),
        "_tests_text": F.when(~is_list, variant_text(F.col("_tests_value"))),
    })
    parsed = with_tests(staged, "_tests_text", out)
    return parsed.withColumn(out, F.coalesce("_tests_list", out)).drop("_tests_value", "_tests_list", "_tests_text")


def convertible_rows(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of a typed table that can be converted, and the others with a reason (E4): the prompt,
    solution or tests that the aliases choose must not be binary data other than UTF-8 text. Rejects
    hold the columns ``keep``, the reason and the row as JSON (binary in base64) as ``raw``."""
    groups = {"prompt": PROMPT_ALIASES, "solution": SOLUTION_ALIASES, "tests": TESTS_ALIASES}
    binary = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
    reasons = []
    for group, names in groups.items():
        if binary & {n for n in names if n in df.columns}:
            kind = F.schema_of_variant(as_variant(first_non_empty(df.schema, names), alias_type(df.schema, names)))
            reasons.append(F.when(kind == "BINARY", F.lit(f"no text: {group} is binary")))
    reason = F.coalesce(*reasons, F.lit(None).cast("string")) if reasons else F.lit(None).cast("string")
    known = df.withColumn("_reason", reason)
    raw = F.to_json(F.struct(*(c for c in df.columns if c not in keep)))
    return known.where(F.col("_reason").isNull()).drop("_reason"), known.where(F.col("_reason").isNotNull()).select(
        *keep, F.col("_reason").alias("reason"), raw.alias("raw")
    )


def training_records(
    df: DataFrame,
    index_col: str,
    data_source: str = DEFAULT_DATA_SOURCE,
    ability: str = DEFAULT_ABILITY,
    split: str = DEFAULT_SPLIT,
) -> DataFrame:
    """Nested training record per input row (P5 P6). Alias columns may have any types: a prompt or
    solution that is no string becomes its JSON text.

    ``index_col`` holds the row position (see ``sampling.dense_index``). Other input columns
    go to ``extra_info.extra`` as JSON text, except the consumed keys; a source ``index`` or
    ``split`` column replaces the computed value, as the reference's overwrite does.
    """
    cols = set(df.columns)
    prompt = first_text(df.schema, PROMPT_ALIASES)
    solution = first_text(df.schema, SOLUTION_ALIASES)
    extra_names = sorted(c for c in cols if c not in CONSUMED_KEYS and c != index_col and c not in ("index", "split"))
    extra = (
        F.create_map(*[x for n in extra_names for x in (F.lit(n), _json_text(F.col(n)))])
        if extra_names
        else F.create_map().cast("map<string,string>")
    )
    # a source index that is no whole number stays as it is in ``extra``
    given = F.try_to_number(F.col("index").cast("string"), F.lit("S999999999999999999")).cast("bigint") if "index" in cols else None
    index = F.col(index_col).cast("bigint") if given is None else F.coalesce(given, F.col(index_col).cast("bigint"))
    if given is not None:
        extra = F.when(F.col("index").isNotNull() & given.isNull(), F.map_concat(extra, F.create_map(F.lit("index"), _json_text(F.col("index"))))).otherwise(extra)
    split_c = F.col("split").cast("string") if "split" in cols else F.lit(split)
    staged = _with_tests_value(df, "_tests")
    return staged.select(
        prompt.alias("prompt"),
        F.lit(data_source).alias("data_source"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(REWARD_STYLE).alias("style"), F.col("_tests").alias("ground_truth")).alias("reward_model"),
        F.struct(
            index.alias("index"),
            split_c.alias("split"),
            F.col("_tests").alias("tests"),
            solution.alias("solution"),
            extra.alias("extra"),
        ).alias("extra_info"),
    )


def _json_text(c: Column) -> Column:
    """JSON text of any value (null stays null)."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1))


def conversion_report(records: DataFrame) -> DataFrame:
    """Total, with-solution count and percent, mean tests per record (null when empty)."""
    n = F.count(F.lit(1))
    with_sol = F.count_if(F.col("extra_info.solution") != "")
    return records.agg(
        n.alias("total"),
        with_sol.alias("with_solution"),
        F.try_divide(with_sol.cast("double") * 100.0, n.cast("double")).alias("with_solution_pct"),
        F.avg(F.size("reward_model.ground_truth").cast("double")).alias("avg_tests"),
    )


# ------------------------------------------------------------------ chat

def sft_messages(instruction: str | Column, output: str | Column, system_prompt: str | None = DEFAULT_SYSTEM_PROMPT) -> Column:
    """[system?, user, assistant] messages from two text columns."""
    def msg(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))

    parts = [msg("user", col_(instruction)), msg("assistant", col_(output))]
    if system_prompt is not None:
        parts.insert(0, msg("system", F.lit(system_prompt)))
    return F.array(*parts)


def message_tokens(msgs: str | Column, counter=count_tokens, generation_prompt: bool = True) -> Column:
    return counter(render_messages(msgs, generation_prompt))


def turn_token_counts(turns: DataFrame, conv_col: str = "conv_id", counter=count_tokens, generation_prompt: bool = True) -> DataFrame:
    """Tokens of each whole rendered conversation from a turn table, without building the
    conversation: each turn renders to a newline-terminated piece, pieces never merge into
    one token, so the count of the whole is the sum of the per-turn counts (map-side
    partial sums; a very long conversation is never gathered in one row)."""
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    per_conv = turns.groupBy(conv_col).agg(F.sum(counter(piece)).alias("n_tokens"), F.count(F.lit(1)).alias("n_turns"))
    if generation_prompt:
        per_conv = per_conv.withColumn("n_tokens", F.col("n_tokens") + counter(F.lit("<|assistant|>\n")))
    return per_conv


# ------------------------------------------------------------------ records of unknown shape (S1 -> P1 P2 P5 P6)

def _present_sql(x: str) -> str:
    """SQL text of the alias resolver's presence test on a VARIANT column reference ``x``: JSON
    null and absent are missing, a blank string and an empty array too; anything else (0,
    false, {}) is present."""
    k = f"schema_of_variant({x})"
    strip = r"'(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$'"
    return (
        f"(CASE WHEN {x} IS NULL OR {k} IN ('VOID', 'NULL') THEN false "
        f"WHEN {k} = 'STRING' THEN regexp_replace(try_variant_get({x}, '$', 'string'), {strip}, '') <> '' "
        f"WHEN {k} LIKE 'ARRAY%' THEN size(try_variant_get({x}, '$', 'array<variant>')) > 0 "
        f"ELSE true END)"
    )


def typed_record_fields(records: DataFrame, v: str = "v") -> DataFrame:
    """``prompt``, ``solution`` (text) and ``tests`` (array<string>) resolved from VARIANT
    records through the alias lists, plus ``extra`` (other keys as JSON text), ``src_index``
    and ``src_split`` (a source ``index``/``split`` that replaces the computed one).

    Built in stages of named columns so every extracted value is computed once per row and the
    expression trees stay small (each alias is fetched once, tested once, picked once).
    """
    from rewardframe.sources.readers import variant_extra

    c = F.col(v)
    groups = {"prompt": PROMPT_ALIASES, "solution": SOLUTION_ALIASES, "tests": TESTS_ALIASES}
    names = sorted({n for ns in groups.values() for n in ns})
    # built as SQL text: one parse per projection instead of one driver round trip per node
    fetched = records.selectExpr("*", *[f"try_variant_get(`{v}`, '$.{n}', 'variant') AS `_a_{n}`" for n in names])
    picked = fetched.selectExpr(
        *[f"`{c}`" for c in records.columns],
        *[f"coalesce({', '.join(f'CASE WHEN {_present_sql(f"`_a_{n}`")} THEN `_a_{n}` END' for n in ns)}) AS `_v_{g}`"
          for g, ns in groups.items()],
    )
    tv = F.col("_v_tests")
    typed = picked.select(
        *records.columns,
        F.coalesce(variant_text(F.col("_v_prompt")), F.lit("")).alias("prompt"),
        F.coalesce(variant_text(F.col("_v_solution")), F.lit("")).alias("solution"),
        F.schema_of_variant(tv).alias("_tk"),
        F.when(tv.isNotNull(), variant_text(tv)).alias("_tt"),
        tv,
    )
    parsed = with_tests(typed, "_tt", "_tp")
    tests = F.when(F.col("_tk") == "ARRAY<STRING>", F.try_variant_get("_v_tests", "$", "array<string>")).when(
        F.col("_tt").isNotNull(), F.col("_tp")
    )
    return parsed.select(
        *records.columns,
        "prompt",
        "solution",
        F.coalesce(tests, F.array().cast("array<string>")).alias("tests"),
        # a source index that is no whole number stays as it is in ``extra``
        F.map_filter(
            variant_extra(c, CONSUMED_KEYS + ["split"]),
            lambda k, _: (k != "index") | F.try_variant_get(c, "$.index", "bigint").isNull(),
        ).alias("extra"),
        F.try_variant_get(c, "$.index", "bigint").alias("src_index"),
        F.try_variant_get(c, "$.split", "string").alias("src_split"),
    )


def convertible(records: DataFrame, v: str = "v") -> tuple[DataFrame, DataFrame]:
    """Records that can be converted, and the others with a reason (E4): a record must be an
    object. Rejects keep their columns but the VARIANT, whose JSON text is ``raw``."""
    kind = F.schema_of_variant(v)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    others = records.where(~is_object)
    reason = F.concat(F.lit("not an object: "), F.coalesce(F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)), F.lit("null")))
    return records.where(is_object), others.select(
        *[c for c in records.columns if c != v], reason.alias("reason"), F.to_json(v).alias("raw")
    )


def records_from_variant(
    records: DataFrame,
    index_col: str,
    v: str = "v",
    data_source: str = DEFAULT_DATA_SOURCE,
    ability: str = DEFAULT_ABILITY,
    split: str = DEFAULT_SPLIT,
) -> DataFrame:
    """Training records from VARIANT rows (as read by ``readers.read_lenient``/``read_any``)."""
    t = typed_record_fields(records, v)
    return t.select(
        F.col("prompt"),
        F.lit(data_source).alias("data_source"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(REWARD_STYLE).alias("style"), F.col("tests").alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.coalesce(F.col("src_index"), F.col(index_col).cast("bigint")).alias("index"),
            F.coalesce(F.col("src_split"), F.lit(split)).alias("split"),
            F.col("tests").alias("tests"),
            F.col("solution").alias("solution"),
            F.col("extra").alias("extra"),
        ).alias("extra_info"),
    )


MESSAGES_TYPE = "array<struct<role string, content string>>"


def prompt_tokens(prompt: str | Column, counter=count_tokens, generation_prompt: bool = True) -> Column:
    """Tokens of a prompt stored as JSON text of chat messages (statistics variant of P9):
    rendered with the generation prompt and counted; text that is not a JSON list of messages
    (or a null) counts 0."""
    v = F.try_parse_json(col_(prompt))
    msgs = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", MESSAGES_TYPE))
    return F.coalesce(F.when(msgs.isNotNull(), counter(render_messages(msgs, generation_prompt))), F.lit(0)).cast("bigint")


def sample_tokens(df: DataFrame, col: str, counter=count_tokens) -> Column:
    """Token length of a sample column as the overlong filter measures it: a messages array is
    rendered with the generation prompt; a plain string is first wrapped as one user message."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        msgs = F.array(F.struct(F.lit("user").alias("role"), F.col(col).alias("content")))
    else:
        msgs = F.col(col)
    return counter(render_messages(msgs, generation_prompt=True))


def within_tokens(df: DataFrame, col: str, max_tokens: int, counter=count_tokens, out: str = "n_tokens") -> DataFrame:
    """Rows whose sample has at most ``max_tokens`` tokens, with the count as ``out`` (F4). The count
    is a generated column: a filter on a plain one would be pushed below it and count a second time."""
    counted = df.select("*", F.explode(F.array(sample_tokens(df, col, counter))).alias(out))
    return counted.where(F.col(out) <= max_tokens)

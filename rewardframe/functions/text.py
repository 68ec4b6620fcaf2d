"""Native column functions for text: stripping, aliases, fences, previews, formatting.

All of them build JVM-side expressions (whole-stage codegen); none calls Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for equal results.
# Alias lists of the record converter, in order of preference.
PROMPT_ALIASES = ["prompt", "problem", "problem_statement", "description", "question", "input"]
SOLUTION_ALIASES = ["solution", "code", "answer", "response", "completion", "output"]
TESTS_ALIASES = ["tests", "test_cases", "test", "assertions", "checks"]
# Keys of a dict prompt that hold its text, in order.
PROMPT_TEXT_KEYS = ["text", "content", "description", "problem", "question"]
# Code fence patterns: any fence with optional "python" tag (scoring, last block wins);
# "```python\n" and "```\n" fences (generator, first block wins).
FENCE_ANY = r"(?s)```(?:python)?\s*(.*?)\s*```"
FENCE_PYTHON = r"(?s)```python\n(.*?)```"
FENCE_PLAIN = r"(?s)```\n(.*?)```"

# Python's str.strip() whitespace: Unicode White_Space plus the separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)^{_WS}+|{_WS}+$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()`` with no argument (``trim`` only removes spaces)."""
    return F.regexp_replace(col_(c), _STRIP, "")


def is_blank(c: str | Column) -> Column:
    """True when null or empty after Python strip."""
    c = col_(c)
    return c.isNull() | (py_strip(c) == "")


def non_empty(c: Column, dtype: T.DataType) -> Column:
    """Presence test of the alias resolver: blank strings and empty arrays count as missing,
    every other non-null value (0, False, NaN, empty struct) as present."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (py_strip(c) != "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(dtype, T.VariantType):
        kind = F.schema_of_variant(c)
        return (
            F.when(c.isNull() | kind.isin("VOID", "NULL"), False)
            .when(kind == "STRING", py_strip(F.try_variant_get(c, "$", "string")) != "")
            .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(c, "$", "array<variant>")) > 0)
            .otherwise(True)
        )
    return c.isNotNull()


def _has_other_keys(dtype: T.DataType) -> bool:
    """Whether a map with keys other than strings is anywhere in the type."""
    if isinstance(dtype, T.MapType):
        return not isinstance(dtype.keyType, T.StringType) or _has_other_keys(dtype.valueType)
    if isinstance(dtype, T.ArrayType):
        return _has_other_keys(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_has_other_keys(f.dataType) for f in dtype.fields)


def as_variant(c: Column, dtype: T.DataType) -> Column:
    """A value of any type as a VARIANT that keeps its kind. Binary values that are UTF-8 become
    text, others stay binary; maps with keys other than strings get their keys as text."""
    if isinstance(dtype, T.VariantType):
        return c
    if isinstance(dtype, T.BinaryType):
        text = c.cast("string")
        return F.when(F.is_valid_utf8(text), text.cast("variant")).otherwise(c.cast("variant"))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(c)) if _has_other_keys(dtype) else F.to_variant_object(c)
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.NullType, T.TimeType)):
        return c.cast("string").cast("variant")
    return c.cast("variant")


def variant_text(v: Column) -> Column:
    """A string value as is (untrimmed), any other value as its JSON text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def alias_type(schema: T.StructType, names: Sequence[str]) -> T.DataType:
    """Type of what ``first_non_empty`` gives: that of the alias columns if they agree, else VARIANT."""
    types = {f.dataType.simpleString(): f.dataType for f in schema.fields if f.name in names}
    return next(iter(types.values())) if len(types) == 1 else T.VariantType() if types else T.StringType()


def first_non_empty(schema: T.StructType, names: Sequence[str], default=None) -> Column:
    """First alias column that is present and non-empty, untrimmed; ``default`` when none is.

    Absent columns are skipped at plan time (the schema is known), so the expression only
    touches columns that exist. Columns of different types give a VARIANT: the value is chosen by
    presence and keeps its kind, no column is cast to another's type.
    """
    fields = {f.name: f.dataType for f in schema.fields}
    mixed = isinstance(alias_type(schema, names), T.VariantType)
    branches = [
        F.when(non_empty(F.col(n), fields[n]), as_variant(F.col(n), fields[n]) if mixed else F.col(n)) for n in names if n in fields
    ]
    if default is not None or not branches:
        branches.append(F.lit(default).cast("variant") if mixed else F.lit(default))
    return F.coalesce(*branches) if len(branches) > 1 else branches[0]


def first_text(schema: T.StructType, names: Sequence[str], default: str = "") -> Column:
    """The first non-empty alias value as text: strings as they are, other kinds as JSON text."""
    dtype = alias_type(schema, names)
    if isinstance(dtype, T.StringType):
        return first_non_empty(schema, names, default)
    picked = first_non_empty(schema, names)
    return F.coalesce(variant_text(as_variant(picked, dtype)), F.lit(default))


def truthy_first(*cols: str | Column, default: str = "") -> Column:
    """``a or b or c`` on strings: empty string and null are false, a blank string is true."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols], F.lit(default))


def fence_last(c: str | Column) -> Column:
    """Code of the last fenced block (optionally tagged python), stripped; null without a fence."""
    return py_strip(F.try_element_at(F.regexp_extract_all(col_(c), F.lit(FENCE_ANY), 1), F.lit(-1)))


def has_fence(c: str | Column) -> Column:
    return F.regexp_like(F.coalesce(col_(c), F.lit("")), F.lit(FENCE_ANY))


def fence_first(c: str | Column) -> Column:
    """First ```python block, else first plain ``` block (both stripped), else the text itself."""
    c = col_(c)
    py_blocks = F.regexp_extract_all(c, F.lit(FENCE_PYTHON), 1)
    plain_blocks = F.regexp_extract_all(c, F.lit(FENCE_PLAIN), 1)
    return (
        F.when(F.size(py_blocks) > 0, py_strip(F.element_at(py_blocks, 1)))
        .when(F.size(plain_blocks) > 0, py_strip(F.element_at(plain_blocks, 1)))
        .otherwise(c)
    )


def preview(c: str | Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def pct1(x: str | Column) -> Column:
    """Fraction as a percent text with one decimal, half-up: 0.1234 -> '12.3%'."""
    return F.concat(F.round(col_(x) * 100.0, 1).cast("string"), F.lit("%"))


def basename(c: str | Column) -> Column:
    """Last path component; trailing slashes are ignored as ``Path(x).name`` does."""
    return F.substring_index(F.regexp_replace(col_(c), "/+$", ""), "/", -1)


def assert_lines(c: str | Column, limit: int = 5) -> Column:
    """Lines that start with ``assert `` after stripping, stripped, first ``limit`` of them."""
    lines = F.transform(F.split(F.coalesce(col_(c), F.lit("")), "\n"), lambda s: py_strip(s))
    return F.slice(F.filter(lines, lambda s: s.startswith("assert ")), 1, limit)


def render_messages(msgs: str | Column, generation_prompt: bool = True) -> Column:
    """Chat rendering used for token counting: each message as ``<|role|>\\ncontent\\n``,
    followed by the assistant header when a generation prompt is requested."""
    body = F.array_join(
        F.transform(col_(msgs), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n"))),
        "",
    )
    return F.concat(body, F.lit("<|assistant|>\n")) if generation_prompt else body

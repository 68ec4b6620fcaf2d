"""Test lists from whatever a dataset stores: JSON text, Python literal text, arrays, dicts.

Native fast path: the text is parsed as JSON into a VARIANT; arrays of strings, JSON string
scalars and objects whose test key holds either are resolved JVM-side. Everything else (Python
literals, nested lists, numbers, objects inside lists, non-JSON text) goes through one Arrow UDF;
rows on the fast path pass null to it.
"""

from __future__ import annotations

import ast
import io
import json
import tokenize
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for equal results.
# Keys of a dict that hold its tests, in order of preference.
TEST_KEYS = ["test", "tests", "test_cases", "assertion", "check"]


class NotThisForm(ValueError):
    """A decoder's way to say that a text has another form."""


def _from_json(text: str):
    return json.loads(text)


def _from_literal(text: str):
    return ast.literal_eval(text)


def _bracketed(text: str) -> str:
    if not (text.startswith("[") and text.endswith("]")):
        raise NotThisForm
    return text


def _from_constants(text: str) -> list[str]:
    """Strings of a bracketed text that is no literal (a printed array without commas): none of
    them if it is not even an expression."""
    try:
        tree = ast.parse(_bracketed(text))
    except (SyntaxError, RecursionError, MemoryError):
        return []
    return [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]


def _from_tokens(text: str) -> list[str]:
    """Each string token of a bracketed text by itself, so ``['a' 'b']`` holds two tests."""
    tokens = tokenize.generate_tokens(io.StringIO(_bracketed(text)).readline)
    parts = [ast.literal_eval(t.string) for t in tokens if t.type == tokenize.STRING]
    if not parts:
        raise NotThisForm
    return parts


def _as_is(text: str) -> list[str]:
    return [text]


#: Decoders of a test text, tried in turn until one accepts it.
DECODERS: tuple[Callable[[str], object], ...] = (_from_json, _from_literal, _from_constants, _as_is)
#: The same with adjacent string literals kept apart (JSON has none).
SPLITTING_DECODERS = (_from_json, _from_tokens, *DECODERS[1:])


def _decoded(text: str, decoders) -> object:
    for decode in decoders:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return decode(text)
        except Exception:  # noqa: BLE001 - another form: the next decoder tries
            continue
    return None


def _leaves(value) -> list[str]:
    """Text of everything in nested lists, in order; nulls are left out."""
    out, waiting = [], [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, list):
            waiting += reversed(x)
        elif x is not None:
            out.append(str(x))
    return out


def parse_tests_py(value, split_adjacent: bool = False) -> list[str]:
    """Tests of one value (a text, a list, a dict or null)."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, str):
        text = value.strip()
        value = _decoded(text, SPLITTING_DECODERS if split_adjacent else DECODERS) if text else None
    if isinstance(value, dict):
        value = next((value[k] for k in TEST_KEYS if k in value), value)
    return [t for t in map(str.strip, _leaves(value)) if t]


def _udf(split_adjacent: bool):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def parse(text: pa.Array) -> pa.Array:
        coded = text.dictionary_encode()
        parsed = [parse_tests_py(t, split_adjacent) for t in coded.dictionary.to_pylist()]
        return pa.array(parsed, pa.list_(pa.string())).take(coded.indices)

    return parse


_PARSE = {False: _udf(False), True: _udf(True)}


def with_tests(df: DataFrame, text_col: str, out: str = "tests", split_adjacent: bool = False) -> DataFrame:
    """Adds ``out``, the tests of a text column, in stages of named columns: the text is stripped
    once, parsed once and inspected once per row. The stages are written as SQL text: one parse
    per stage instead of one driver round trip per expression node."""
    keep = [f"`{c}`" for c in df.columns if c != out]
    t = f"`{text_col}`"
    strip = r"'(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$'"
    chosen = ", ".join(f"CASE WHEN map_contains_key(__wt_m, '{k}') THEN __wt_m['{k}'] END" for k in TEST_KEYS)
    clean = f"filter(transform({{a}}, x -> regexp_replace(x, {strip}, '')), x -> x <> '')"
    s = df.selectExpr("*", f"regexp_replace({t}, {strip}, '') AS __wt_s")
    s = s.selectExpr("*", "try_parse_json(__wt_s) AS __wt_v")
    s = s.selectExpr("*", "schema_of_variant(__wt_v) AS __wt_k", "try_variant_get(__wt_v, '$', 'map<string,variant>') AS __wt_m")
    s = s.selectExpr("*", f"CASE WHEN __wt_k LIKE 'OBJECT%' THEN coalesce({chosen}) ELSE __wt_v END AS __wt_g")
    s = s.selectExpr("*", "schema_of_variant(__wt_g) AS __wt_gk")
    native = (
        f"CASE WHEN {t} IS NULL OR __wt_s = '' THEN CAST(array() AS array<string>) "
        "WHEN __wt_v IS NULL OR __wt_g IS NULL THEN CAST(NULL AS array<string>) "
        f"WHEN __wt_gk = 'ARRAY<STRING>' THEN {clean.format(a="try_variant_get(__wt_g, '$', 'array<string>')")} "
        f"WHEN __wt_gk = 'STRING' THEN {clean.format(a="array(try_variant_get(__wt_g, '$', 'string'))")} "
        "WHEN __wt_gk IN ('ARRAY<VOID>', 'VOID') THEN CAST(array() AS array<string>) "
        "ELSE CAST(NULL AS array<string>) END AS __wt_n"
    )
    s = s.selectExpr(*keep, f"{t} AS __wt_t", native)
    fallback = _PARSE[split_adjacent](F.when(F.col("__wt_n").isNull(), F.col("__wt_t")))
    cols = [c for c in df.columns if c != out]
    return s.select(*cols, F.coalesce(F.col("__wt_n"), fallback, F.array().cast("array<string>")).alias(out))

"""Python-source checks that need Python's own parser: the only per-row Python in the library.

Each is one Arrow UDF; inside a batch every distinct text is parsed once, so repeated rollouts of
the same code cost one parse per batch without a shuffle to de-duplicate them.
"""

from __future__ import annotations

import ast
import bisect
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rewardframe.functions.text import col_, is_blank

CHECK_TYPE = T.StructType(
    [
        T.StructField("parses", T.BooleanType()),
        T.StructField("compiles", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
    ]
)


#: Rows of a batch that are looked at together: their texts are copied into Python objects.
SLICE_ROWS = 256


def _distinct(values: pa.Array, fn: Callable, kind: pa.DataType) -> pa.Array:
    """``fn`` of every value, computed once for each distinct one of a slice; null stays null. Only one
    slice's texts and results are Python objects at a time, however large the batch is."""
    parts = []
    for at in range(0, len(values), SLICE_ROWS):
        coded = values.slice(at, SLICE_ROWS).dictionary_encode()
        results = pa.array((fn(v.as_py()) for v in coded.dictionary), kind)
        parts.append(results.take(coded.indices))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def check_source(text: str) -> dict:
    """Whether a text parses as Python, whether it compiles, and the error's class and place."""
    found = {"parses": False, "compiles": False, "error": None, "line": None, "offset": None}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
            found["parses"] = True
            compile(text, "<string>", "exec", dont_inherit=True)
            del tree
            found["compiles"] = True
        except SyntaxError as e:
            found |= {"error": type(e).__name__, "line": e.lineno, "offset": e.offset}
        except (ValueError, RecursionError, MemoryError, OverflowError) as e:  # null bytes, too deep nesting
            found["error"] = type(e).__name__
    return found


@F.arrow_udf(CHECK_TYPE)
def _check_udf(text: pa.Array) -> pa.Array:
    return _distinct(text, check_source, to_arrow_type(CHECK_TYPE))


def check_code(text: str | Column) -> Column:
    """Struct (parses, compiles, error, line, offset); a null text gives null and is not parsed."""
    return _check_udf(col_(text))


def validate_code(code: str | Column) -> Column:
    """Struct (has_code, syntax_valid, compile_valid, error, line, offset). Blank code never
    reaches Python."""
    c = col_(code)
    has_code = ~is_blank(c)
    v = check_code(F.when(has_code, c))
    return F.struct(
        has_code.alias("has_code"),
        F.coalesce(v["parses"], F.lit(False)).alias("syntax_valid"),
        F.coalesce(v["compiles"], F.lit(False)).alias("compile_valid"),
        v["error"].alias("error"), v["line"].alias("line"), v["offset"].alias("offset"),
    )


# ------------------------------------------------------------------- screening

# Fixed values that must equal the reference's for equal results.
BANNED_IMPORT_ROOTS = [
    "os", "shutil", "subprocess", "socket", "pathlib", "tempfile", "glob", "resource", "signal",
    "ctypes", "multiprocessing", "threading", "asyncio",
]
BANNED_CALL_NAMES = ["open", "exec", "eval", "compile", "__import__", "input", "breakpoint"]
BANNED_ATTR_CALLS = [
    ("os", "system"),
    ("os", "popen"),
    ("os", "spawnl"),
    ("os", "spawnlp"),
    ("os", "spawnv"),
    ("os", "spawnvp"),
    ("os", "remove"),
    ("os", "unlink"),
    ("os", "rmdir"),
    ("os", "removedirs"),
    ("os", "rename"),
    ("os", "replace"),
    ("os", "chdir"),
    ("os", "walk"),
    ("shutil", "rmtree"),
    ("shutil", "move"),
    ("shutil", "copytree"),
    ("subprocess", "run"),
    ("subprocess", "Popen"),
    ("subprocess", "call"),
    ("subprocess", "check_call"),
    ("subprocess", "check_output"),
    ("socket", "socket"),
]
# The message of a violation, by its kind.
SCREEN_MESSAGES = {
    "import": "import '{}' is not allowed",
    "from": "from '{}' import ... is not allowed",
    "call": "call '{}(...)' is not allowed",
    "aliased": "use of aliased dangerous module '{}' is not allowed",
    "attr": "call '{}(...)' is not allowed",
}
#: All violations: kind and name.
BANNED = frozenset(
    [("import", m) for m in BANNED_IMPORT_ROOTS]
    + [("from", m) for m in BANNED_IMPORT_ROOTS]
    + [("aliased", m) for m in BANNED_IMPORT_ROOTS]
    + [("call", n) for n in BANNED_CALL_NAMES]
    + [("attr", f"{m}.{n}") for m, n in BANNED_ATTR_CALLS]
)
FINDING_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "name", "message")]))


def _outline(tree: ast.AST) -> Iterator[ast.AST]:
    """The tree's nodes in the order of their fields, a node before its children."""
    waiting = [iter((tree,))]
    while waiting:
        node = next(waiting[-1], None)
        if node is None:
            waiting.pop()
        else:
            yield node
            waiting.append(ast.iter_child_nodes(node))


def _facts(tree: ast.AST) -> tuple[list[tuple], dict[str, list[tuple[int, str]]]]:
    """What a script imports and calls, in order, and which module each name stands for from
    where on. Facts: (place, kind, base, name)."""
    facts: list[tuple[int, str, str | None, str]] = []
    names: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for place, node in enumerate(_outline(tree)):
        match node:
            case ast.Import(names=imported):
                for a in imported:
                    root = a.name.partition(".")[0]
                    names[a.asname or root].append((place, root))
                    facts.append((place, "import", None, root))
            case ast.ImportFrom(module=str(module), names=imported) if module:
                root = module.partition(".")[0]
                for a in imported:
                    names[a.asname or a.name].append((place, root))
                facts.append((place, "from", None, root))
            case ast.Call(func=ast.Name(id=name)):
                facts += [(place, "call", None, name), (place, "aliased", name, "")]
            case ast.Call(func=ast.Attribute(value=ast.Name(id=base), attr=name)):
                facts.append((place, "attr", base, name))
    return facts, names


def screen_findings(code: str | None) -> list[tuple[str, str]]:
    """Violations (kind, name) of a script in its order: the facts that the ban list holds, with
    names resolved to the module that they stand for there. Code that does not parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            facts, names = _facts(ast.parse(code or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []

    def module(name: str, place: int) -> str | None:
        known = names.get(name, [])
        at = bisect.bisect_right(known, place, key=lambda b: b[0])
        return known[at - 1][1] if at else None

    resolved = []
    for place, kind, base, name in facts:
        if kind == "aliased":
            resolved.append((kind, module(base, place)))
        elif kind == "attr":
            resolved.append((kind, f"{module(base, place) or base}.{name}"))
        else:
            resolved.append((kind, name))
    return [f for f in resolved if f in BANNED]


def _findings(code: str) -> list[dict]:
    return [{"kind": k, "name": n, "message": SCREEN_MESSAGES[k].format(n)} for k, n in screen_findings(code)]


@F.arrow_udf(FINDING_TYPE)
def _screen_udf(code: pa.Array) -> pa.Array:
    return _distinct(code, _findings, to_arrow_type(FINDING_TYPE))


def screen_code(code: str | Column) -> Column:
    """Violations of a script as an array of (kind, name, message) in the script's order; empty
    for clean, unparsable and null code."""
    found = _screen_udf(col_(code))
    return F.coalesce(found, F.array().cast(FINDING_TYPE))


def screen_message(violations: str | Column) -> Column:
    """Distinct messages in first-seen order joined by '; ', null when clean."""
    messages = F.array_distinct(F.transform(col_(violations), lambda v: v["message"]))
    return F.when(F.size(messages) > 0, F.array_join(messages, "; "))


def register_sql_functions(spark) -> None:
    """Register for SQL use ``screen_code`` (an array of violations), ``screen_code_table`` (a table of them,
    for LATERAL), ``check_code`` and its other name ``validate_code``. The table function has an SQL body
    around the Arrow UDF, as Spark does not take Arrow table functions in a lateral join."""
    spark.udf.register("screen_code", _screen_udf)
    for name in ("check_code", "validate_code"):
        spark.udf.register(name, _check_udf)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION screen_code_table(code STRING)
        RETURNS TABLE(pos INT, kind STRING, name STRING, message STRING)
        RETURN SELECT p, v.kind, v.name, v.message FROM (SELECT posexplode(screen_code(screen_code_table.code)) AS (p, v))""")

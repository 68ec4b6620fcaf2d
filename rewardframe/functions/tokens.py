"""Token counting: native by default, pluggable with any tokenizer as an Arrow UDF.

The model tokenizer of the reference is external and not shipped; the default counter is a
JVM-side regular expression (words of ASCII letters, digits and underscore; every other
non-space character alone), so counting stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardframe.functions.text import col_

DEFAULT_TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"


_WORD_RUN = r"[A-Za-z0-9_]+"
_MARK = "\u0001"
# the whitespace of the pattern's \s (Java's default class): space, tab, LF, VT, FF, CR
_SPACE = " \t\n\x0b\x0c\r"


def count_tokens(text: str | Column) -> Column:
    """Default counter: number of matches of ``DEFAULT_TOKEN_PATTERN``; null text counts 0.

    One regex pass collapses every word run to a single marker character; every character left
    that is not whitespace is then exactly one match (a marker or a symbol), counted with
    ``translate`` (a character map, no regex). ``regexp_count`` would materialize every match
    as a string; this gives the same count with one scan.
    """
    c = col_(text)
    n = F.length(F.translate(F.regexp_replace(c, _WORD_RUN, _MARK), _SPACE, ""))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def tokenizer_counter(encode: Callable[[str], list]) -> Callable[[str | Column], Column]:
    """Counter backed by a Python tokenizer (``encode(text) -> ids``), batched through Arrow.

    ``encode`` must be picklable; it is loaded once per Python worker.
    """

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: 0 if t is None else len(encode(t))).astype("int64")

    def counter(text: str | Column) -> Column:
        return _count(col_(text))

    return counter

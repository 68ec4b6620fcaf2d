"""SQL names for the library's functions, for use in ``spark.sql``.

``count_tokens`` and ``py_strip`` are SQL-bodied temporary functions: the analyzer inlines
their bodies, so they stay native expressions inside whole-stage codegen. ``check_code`` (also
named ``validate_code``) and ``screen_code`` (an array of violations) are Arrow UDFs; ``screen_code_table``
gives the violations as rows: ``select * from codes, lateral screen_code_table(codes.code)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rewardframe.functions.code import register_sql_functions as _register_python
from rewardframe.session import ship_package

_SQL_FUNCTIONS = [
    r"""CREATE OR REPLACE TEMPORARY FUNCTION py_strip(t STRING) RETURNS STRING
        RETURN regexp_replace(t, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '')""",
    """CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(t STRING) RETURNS BIGINT
        RETURN CAST(coalesce(length(translate(regexp_replace(t, '[A-Za-z0-9_]+', char(1)),
                                              concat(' ', char(9), char(10), char(11), char(12), char(13)), '')), 0) AS BIGINT)""",
]


def register_all(spark: SparkSession) -> None:
    ship_package(spark)
    for stmt in _SQL_FUNCTIONS:
        spark.sql(stmt)
    _register_python(spark)

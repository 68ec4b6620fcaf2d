"""The SQL names agree with the DataFrame functions."""

from pyspark.sql import functions as F

from rewardframe.functions.sql import register_all
from rewardframe.functions.text import py_strip
from rewardframe.functions.tokens import count_tokens
from rewardframe.session import table

SF = "/root/testdata/sf0.001"


def test_sql_functions_match(spark):
    register_all(spark)
    d = table(spark, SF, "documents")
    d.createOrReplaceTempView("docs_t")
    a = {r[0]: (r[1], r[2]) for r in spark.sql("select doc_id, count_tokens(text), py_strip(concat(' ', lang, chr(10))) from docs_t").collect()}
    b = {r[0]: (r[1], r[2]) for r in d.select("doc_id", count_tokens("text"), py_strip(F.concat(F.lit(" "), "lang", F.lit("\n")))).collect()}
    assert a == b
    got = spark.sql("select count_tokens('hello, world! é') as n").first()["n"]
    assert got == 5


def test_sql_udfs(spark):
    register_all(spark)
    spark.createDataFrame([(1, "import os\nos.system('x')"), (2, "print(1)")], "id int, code string").createOrReplaceTempView("codes_t")
    rows = spark.sql("select id, v.kind, v.name from (select id, posexplode(screen_code(code)) as (pos, v) from codes_t) order by id, pos").collect()
    assert [(r.id, r.kind, r.name) for r in rows] == [(1, "import", "os"), (1, "attr", "os.system")]
    v = spark.sql("select check_code('return 1') as v").first()["v"]
    assert v["parses"] and not v["compiles"] and v["error"] == "SyntaxError"


def test_table_function_and_validation_by_name(spark):
    register_all(spark)
    register_all(spark)  # again is no harm
    spark.createDataFrame([(1, "import os\nos.system('x')"), (2, "print(1)"), (3, None), (4, "eval(")], "id int, code string").createOrReplaceTempView("codes_u")
    rows = spark.sql("select id, f.* from codes_u, lateral screen_code_table(codes_u.code) f order by id, pos").collect()
    assert [(r.id, r.pos, r.kind, r.name) for r in rows] == [(1, 0, "import", "os"), (1, 1, "attr", "os.system")]
    valid = {r.id: r.ok for r in spark.sql("select id, validate_code(code).parses as ok from codes_u").collect()}
    assert valid[1] and valid[2] and not valid[4]

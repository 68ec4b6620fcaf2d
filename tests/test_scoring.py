"""Reward scoring: literal cases from the reference's examples, ordering, rows-only queries
against plain Python on the small fixture."""

import ast
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rewardframe.functions.code import SCREEN_MESSAGES, check_source, screen_code, screen_findings, screen_message
from rewardframe.functions.tests_parse import parse_tests_py, with_tests
from rewardframe.operators import reward as RW
from rewardframe.operators.verify import classify_outcomes

SF = "/root/testdata/sf0.001"
FENCE = "```"


def py_extract(response):
    """Plain-Python statement of the scoring extraction (brute-force check)."""
    if not response:
        return ""
    m = re.findall(r"```(?:python)?\s*(.*?)\s*```", response, re.DOTALL)
    if m:
        return m[-1].strip()
    try:
        ast.parse(response)
        return response.strip()
    except SyntaxError:
        return ""


def _score(spark, rows, outcomes=None, **kw):
    df = spark.createDataFrame(rows, "sample_id long, response string, tests_text string")
    prepared = RW.prepare_responses(df)
    outs = None
    if outcomes is not None:
        outs = spark.createDataFrame(outcomes, "sample_id long, test_idx long, status string, error_type string")
    return {r["sample_id"]: r.asDict() for r in RW.score(prepared, outs, **kw).collect()}


def test_reference_examples(spark):
    add = "def add(a, b):\n    return a + b"
    tests = '["assert add(1, 2) == 3", "assert add(-1, 1) == 0", "assert add(0, 0) == 0"]'
    rows = [
        (1, f"{FENCE}python\n{add}\n{FENCE}", tests),
        (2, f"{FENCE}python\ndef add(a, b) return a + b\n{FENCE}", tests),
        (3, f"{FENCE}python\nreturn 1\n{FENCE}", tests),
        (4, "", tests),
        (5, f"{FENCE}python\n{add}\n{FENCE}", "[]"),
    ]
    outs = [(1, i, "success", None) for i in range(3)]
    got = _score(spark, rows, outs)
    assert got[1]["reward"] == 3.0 and got[1]["acc"] == 1.0 and got[1]["total"] == 3.0
    assert got[2]["reward"] == -1.0 and got[2]["syntax_error"] == 1.0 and got[2]["total"] == 3.0
    assert got[3]["reward"] == -0.5 and got[3]["compile_error"] == 1.0 and got[3]["syntax_valid"] == 1.0
    assert got[4]["reward"] == -1.5 and got[4]["format_error"] == 1.0 and got[4]["total"] == 0.0
    assert got[5]["reward"] == pytest.approx(0.2) and got[5]["total"] == 0.0
    for r in got.values():
        assert r["score"] == r["reward"] and r["is_markdown"] == 0.0


def test_reward_order_and_modes(spark):
    code = f"{FENCE}python\nx = 1\n{FENCE}"
    tests = '["a", "b", "c", "d"]'
    rows = [(i, code, tests) for i in range(1, 6)]
    outs = (
        [(1, i, "success", None) for i in range(4)]
        + [(2, 0, "success", None), (2, 1, "success", None), (2, 2, "error", "ASSERTION_ERROR"), (2, 3, "error", "ASSERTION_ERROR")]
        + [(3, i, "error", "ASSERTION_ERROR") for i in range(4)]
        + [(4, i, "error", "TIMEOUT") for i in range(4)]
        + [(5, 0, "success", None), (5, 1, "error", "TIMEOUT"), (5, 2, "error", "TIMEOUT"), (5, 3, "error", "TIMEOUT")]
    )
    err = _score(spark, rows, outs)
    assert [err[i]["reward"] for i in (1, 2, 3, 4)] == [3.0, 1.0, pytest.approx(-0.2), pytest.approx(-0.2)]
    assert err[5]["reward"] == pytest.approx(0.5) and err[5]["timeout_count"] == 0.0
    tmo = _score(spark, rows, outs, timeout_as="timeout")
    assert tmo[4]["reward"] == pytest.approx(-0.3) and tmo[4]["timeout_count"] == 4.0
    assert tmo[5]["reward"] == pytest.approx(0.2) and tmo[5]["timeout_count"] == 3.0
    # crash < format < syntax < compile < zero-pass < partial < full
    ladder = [RW.CRASH_REWARD, -1.5, -1.0, -0.5, err[3]["reward"], err[2]["reward"], err[1]["reward"]]
    assert ladder == sorted(ladder)


def test_custom_config_merges_defaults(spark):
    cfg = RW.RewardConfig().with_overrides(full_pass_bonus=0.25)
    rows = [(1, f"{FENCE}\nx = 1\n{FENCE}", '["t"]')]
    got = _score(spark, rows, [(1, 0, "success", None)], cfg=cfg)
    assert got[1]["reward"] == pytest.approx(2.25)


def test_fences_last_and_first(spark):
    text = f"plan\n{FENCE}python\ndef a(): pass\n{FENCE}\nthen\n{FENCE}python\ndef b(): pass\n{FENCE}\n"
    from rewardframe.functions.text import fence_first

    df = spark.createDataFrame([(text,)], "r string")
    row = RW.with_checked_code(df.withColumn("first", fence_first("r")), "r", "last").first()
    assert row["last"] == "def b(): pass" and row["first"] == "def a(): pass"


def test_extract_code_fallback_matches_python(spark):
    got = {r["doc_id"]: r["code"] for r in entry.queries()["extract_code_fallback"](spark, SF).collect()}
    from rewardframe.plans.fixtures import fixture

    src = {r["doc_id"]: r["response"] for r in fixture(spark, SF, "fx_responses").collect()}
    assert got == {k: py_extract(v) for k, v in src.items()}


def test_validate_code_matches_python(spark):
    got = {r["doc_id"]: (r["syntax_valid"], r["compile_valid"]) for r in entry.queries()["validate_code"](spark, SF).collect()}
    from rewardframe.plans.fixtures import fixture

    src = {r["doc_id"]: r["response"] for r in fixture(spark, SF, "fx_responses").collect()}
    checked = {k: check_source(py_extract(v)) if py_extract(v).strip() else {"parses": False, "compiles": False} for k, v in src.items()}
    assert got == {k: (v["parses"], v["compiles"]) for k, v in checked.items()}
    assert set(got.values()) == {(False, False), (True, False), (True, True)}


def plain_message(code):
    return "; ".join(dict.fromkeys(SCREEN_MESSAGES[k].format(n) for k, n in screen_findings(code))) or None


def test_screen_code_matches_python(spark):
    got = {r["doc_id"]: r["message"] for r in entry.queries()["screen_code"](spark, SF).collect()}
    from rewardframe.plans.fixtures import fixture

    src = {r["doc_id"]: r["code"] for r in fixture(spark, SF, "fx_screen").collect()}
    assert got == {k: plain_message(v) for k, v in src.items()}


@pytest.mark.parametrize(
    ("code", "found"),
    [
        ("import os\nos.system('x')\nos.system('y')", [("import", "os"), ("attr", "os.system"), ("attr", "os.system")]),
        ("import subprocess as sp\nsp.run(1)", [("import", "subprocess"), ("attr", "subprocess.run")]),
        ("def f(:", []),
        (None, []),
        ("a\0b", []),
        # a name stands for its module only after the import, and for the last one
        ("p(1)\nfrom os import path as p\np(1)", [("from", "os"), ("aliased", "os")]),
        ("import os.path\nimport math as os\nos.system(1)", [("import", "os")]),
        ("import os as o, json\nx = [o.walk(open(1)) for _ in eval('2')]", [("import", "os"), ("attr", "os.walk"), ("call", "open"), ("call", "eval")]),
        ("from . import os\nos.system(1)\nfrom .os import a", [("attr", "os.system"), ("from", "os")]),
        ("import shutil\ndef f():\n    import math as shutil\nshutil.rmtree(1)", [("import", "shutil")]),
        ("f(open)(input())\ng.open()", [("call", "input")]),
    ],
)
def test_screen_findings(code, found):
    assert screen_findings(code) == found


def test_screen_code_column(spark):
    df = spark.createDataFrame([("import os\nos.system(1)\nos.system(2)",), ("x = 1",), (None,)], "c string")
    rows = df.select(screen_code("c").alias("v")).select("v", screen_message("v").alias("m")).collect()
    assert [len(r.v) for r in rows] == [3, 0, 0]
    assert [r.m for r in rows] == ["import 'os' is not allowed; call 'os.system(...)' is not allowed", None, None]


def test_parse_tests_literal_matches_python(spark):
    got = {r["doc_id"]: r["tests"] for r in entry.queries()["parse_tests_literal"](spark, SF).collect()}
    from rewardframe.plans.fixtures import fixture

    src = {r["doc_id"]: r["tests_text"] for r in fixture(spark, SF, "fx_literal_tests").collect()}
    assert got == {k: "|".join(parse_tests_py(v)) for k, v in src.items()}


@pytest.mark.parametrize(
    "text,want",
    [
        ("['a' 'b']", ["ab"]),
        ('{"tests": ["x"]}', ["x"]),
        ("", []),
        ("[1, [2, 3]]", ["1", "2", "3"]),
        ('{"other": 1}', ["{'other': 1}"]),
        ("('a', 'b')", ["('a', 'b')"]),
        ("assert f() == 1", ["assert f() == 1"]),
    ],
)
def test_parse_tests_cases(spark, text, want):
    assert parse_tests_py(text) == want
    df = spark.createDataFrame([(text,)], "t string")
    assert with_tests(df, "t", "x").first()["x"] == want


def test_parse_tests_split_adjacent():
    assert parse_tests_py("['a' 'b']", split_adjacent=True) == ["a", "b"]


def test_classify_literal(spark):
    rows = [
        (1, "S1", 0, False, False, "ok\nS1\n", None),
        (2, "S2", 0, False, False, "exit early", None),
        (3, "S3", None, True, False, "", None),
        (4, "S4", 1, False, True, "", "CUSTOM"),
        (5, "S5", 1, False, False, "Traceback\nAssertionError\nS5", None),
        (6, "S6", 1, False, False, "", ""),
    ]
    df = spark.createDataFrame(rows, "id long, sentinel string, returncode int, timed_out boolean, blocked boolean, output string, error_type string")
    got = {r["id"]: (r["status"], r["message"], r["error_type"]) for r in classify_outcomes(df, ["id"]).collect()}
    assert got[1] == ("success", "All tests passed", None)
    assert got[2] == ("error", "Program exited before tests completed", "INCOMPLETE_TEST_RUN")
    assert got[3] == ("error", "Timeout", "TIMEOUT")
    assert got[4] == ("error", "Security violation", "CUSTOM")
    assert got[5] == ("error", "Traceback\nAssertionError", "ASSERTION_ERROR")
    assert got[6] == ("error", "Execution failed", "RUNTIME_ERROR")


def test_stream_equals_batch(spark):
    from rewardframe.session import table
    from rewardframe.streaming import scoring as ST

    batch = ST.score_stream(ST.event_flags(table(spark, SF, "events")), keep=("sample_id",))
    streamed = entry.queries()["stream_score"](spark, SF)
    b = {r["sample_id"]: round(r["reward"], 6) for r in batch.collect()}
    s = {r["sample_id"]: r["reward"] for r in streamed.collect()}
    assert b == s
    stats = entry.queries()["stream_stats"](spark, SF).first()
    assert stats["total_samples"] == len(b)


def test_group_advantage_of_hot_and_missing_groups(spark):
    rows = [(0, float(i % 7)) for i in range(3000)] + [(None, 1.0), (None, 3.0), (5, 2.0)]
    df = spark.createDataFrame(rows, "prompt_id long, reward double").repartition(6)
    got = RW.group_advantage(df).collect()
    assert len(got) == len(rows)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for r in got:
        x = by[r.prompt_id]
        mean = sum(x) / len(x)
        std = (sum((v - mean) ** 2 for v in x) / (len(x) - 1)) ** 0.5 if len(x) > 1 else 0.0
        assert r.group_mean == pytest.approx(mean) and r.advantage == pytest.approx((r.reward - mean) / (std + 1e-6))


def test_stream_totals_across_batches(spark):
    """Events split into several files, one file per micro-batch: totals equal the batch ones."""
    import tempfile

    from rewardframe.session import table
    from rewardframe.streaming import scoring as ST

    src = tempfile.mkdtemp(prefix="rf-stream-") + "/events"
    ev = table(spark, SF, "events")
    ev.repartition(4).write.parquet(src)
    stream = ST.stream_from_files(spark, src, max_files_per_trigger=1)
    stats = ST.stats_stream(ST.score_stream(ST.event_flags(stream)))
    out, ckpt = ST.scratch_for(spark, "test-stream")
    ST.run_available(stats, out, ckpt, "complete")
    got = ST.latest_result(spark, out).first().asDict()
    want = RW.manager_stats(ST.score_stream(ST.event_flags(ev))).first().asDict()
    assert got == want


def test_reward_score_responses_matches_python(spark):
    from rewardframe.plans.fixtures import fixture

    got = {r.sample_id: (r.reward, r.total, r.code_length) for r in entry.queries()["reward_score_responses"](spark, SF).collect()}
    want = {}
    for r in fixture(spark, SF, "fx_scoring").collect():
        code = py_extract(r.response)
        tests = parse_tests_py(r.tests_text)
        flags = check_source(code)
        syn, comp = flags["parses"], flags["compiles"]
        if not code.strip():
            want[r.doc_id] = (-1.5, 0.0, float(len(code)))
        elif not syn:
            want[r.doc_id] = (-1.0, float(len(tests)), float(len(code)))
        elif not comp:
            want[r.doc_id] = (-0.5, float(len(tests)), float(len(code)))
        else:  # nothing was run: no execution results
            want[r.doc_id] = (0.2, 0.0, float(len(code)))
    assert got == want


def test_crash_row_reaches_the_pipeline(spark):
    """A response whose scoring raised gets -2.0 and empty flags; others are untouched."""
    code = f"{FENCE}python\nx = 1\n{FENCE}"
    outs = [(1, 0, "error", "RUNNER_ERROR"), (2, 0, "success", None)]
    got = _score(spark, [(1, code, '["a"]'), (2, code, '["a"]')], outs, with_reasons=True)
    assert got[1]["reward"] == got[1]["score"] == -2.0
    assert all(got[1][c] == 0.0 for c in RW.REWARD_COLUMNS if c not in ("reward", "score"))
    assert got[1]["reason"] is None and got[2]["reward"] == 3.0


def test_scoring_plan_holds_valid_code_only(spark):
    rows = [(1, f"{FENCE}python\nx = 1\n{FENCE}", '["a", "b"]'), (2, f"{FENCE}\ndef f(:\n{FENCE}", '["a"]'),
            (3, f"{FENCE}\nreturn 1\n{FENCE}", '["a"]'), (4, "", '["a"]'), (5, "y = 2", "[]")]
    prepared = RW.prepare_responses(spark.createDataFrame(rows, "sample_id long, response string, tests_text string"))
    assert sorted((r.sample_id, r.test_idx) for r in RW.plan_scoring(prepared).collect()) == [(1, 0), (1, 1)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028"])
def test_sentinel_goes_at_every_line_end(spark, end):
    df = spark.createDataFrame([(f"AssertionError{end}S{end} x ", "S", 1, False, False)], "output string, sentinel string, returncode int, timed_out boolean, blocked boolean")
    assert classify_outcomes(df, []).first()["message"] == "AssertionError\n x".replace("\n ", "\n ")


def test_a_large_batch_takes_little_python_memory():
    """of a batch only a slice's texts and results are Python objects, and results are the same."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from rewardframe.functions import code as C

    text = "# " + "a long comment " * 200 + "\nimport os\nx = "
    texts = pa.array([None if i % 1000 == 7 else text + str(i // 3) for i in range(6000)])
    tracemalloc.start()
    found = C._distinct(texts, C._findings, to_arrow_type(C.FINDING_TYPE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # the texts take 18 MB
    message = SCREEN_MESSAGES["import"].format("os")
    assert found.to_pylist() == [None if i % 1000 == 7 else [{"kind": "import", "name": "os", "message": message}] for i in range(6000)]
    assert len(C._distinct(texts.slice(0, 0), C._findings, to_arrow_type(C.FINDING_TYPE))) == 0
    few = texts.slice(3, 500)
    assert C._distinct(few, len, pa.int64()).to_pylist() == [t and len(t) for t in few.to_pylist()]

"""Property tests: native Spark expressions agree with plain Python on random input.
Each hypothesis example is a batch of strings evaluated in one Spark job."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rewardframe.functions.tests_parse import parse_tests_py, with_tests
from rewardframe.functions.text import fence_last, py_strip
from rewardframe.functions.tokens import DEFAULT_TOKEN_PATTERN, count_tokens

TEXT = st.lists(
    st.one_of(
        st.characters(blacklist_categories=("Cs",)),
        st.sampled_from([" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\u3000", "\u200b", "`", "```", "python", "é", "_"]),
    ),
    max_size=40,
).map("".join)
BATCH = st.lists(TEXT, min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _run(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


@SETTINGS
@given(BATCH)
def test_strip_matches_python(spark, values):
    got = [r[0] for r in _run(spark, values, py_strip("t"))]
    assert got == [v.strip() for v in values]


@SETTINGS
@given(BATCH)
def test_token_count_matches_pattern(spark, values):
    # the pattern's \s is the ASCII class (Java's default), as with re.ASCII
    pat = re.compile(DEFAULT_TOKEN_PATTERN, re.ASCII)
    got = [r[0] for r in _run(spark, values, count_tokens("t"))]
    assert got == [len(pat.findall(v)) for v in values]


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["a", " x ", "```python\nq = 1\n```", "```\nz\n```", "text", "\n", "```"]), max_size=6).map("".join), min_size=1, max_size=30))
def test_last_fence_matches_python(spark, values):
    got = [r[0] for r in _run(spark, values, fence_last("t"))]
    want = []
    for v in values:
        m = re.findall(r"```(?:python)?\s*(.*?)\s*```", v, re.DOTALL)
        want.append(m[-1].strip() if m else None)
    assert got == want


JSONISH = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text(max_size=6)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.sampled_from(["test", "tests", "check", "x"]), inner, max_size=3)),
    max_leaves=8,
)


@SETTINGS
@given(st.lists(JSONISH, min_size=1, max_size=30))
def test_tests_parse_matches_python(spark, objs):
    values = [json.dumps(o) for o in objs]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = [list(r["tests"]) for r in with_tests(df, "t", "tests").orderBy("i").collect()]
    assert got == [parse_tests_py(v) for v in values]


# --------------------------------------------------------------- rule-heavy operators

def _classify_py(output, sentinel, rc, timed_out, blocked, given):
    cleaned = "\n".join(l for l in output.splitlines() if l.strip() != sentinel).strip()
    if blocked:
        return ("error", cleaned or "Security violation", given or "SECURITY_VIOLATION")
    if timed_out:
        return ("error", "Timeout", "TIMEOUT")
    if rc == 0 and sentinel not in output:
        return ("error", "Program exited before tests completed", "INCOMPLETE_TEST_RUN")
    if rc == 0:
        return ("success", "All tests passed", None)
    for needle, default, etype in (("AssertionError", "Test failed", "ASSERTION_ERROR"), ("SyntaxError", "Syntax error", "SYNTAX_ERROR")):
        if needle in output:
            return ("error", cleaned or default, etype)
    if "FIREJAIL_NOT_AVAILABLE" in output:
        return ("error", cleaned, "FIREJAIL_NOT_AVAILABLE")
    return ("error", cleaned or "Execution failed", given or "RUNTIME_ERROR")


OUTCOME = st.tuples(
    st.lists(st.sampled_from(["S", " S ", "AssertionError", "SyntaxError: x", "FIREJAIL_NOT_AVAILABLE", "out", "", "  "]), max_size=4).map("\n".join),
    st.sampled_from([None, 0, 1, 2]),
    st.booleans(),
    st.booleans(),
    st.sampled_from([None, "", "CUSTOM"]),
)


@SETTINGS
@given(st.lists(OUTCOME, min_size=1, max_size=40))
def test_classify_matches_rules(spark, rows):
    from rewardframe.operators.verify import classify_outcomes

    data = [(i, "S", rc, t, b, out, g) for i, (out, rc, t, b, g) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, sentinel string, returncode int, timed_out boolean, blocked boolean, output string, error_type string")
    got = [(r.status, r.message, r.error_type) for r in classify_outcomes(df, ["id"]).orderBy("id").collect()]
    assert got == [_classify_py(out, "S", rc, t, b, g) for (_, _, rc, t, b, out, g) in data]


def _reward_py(has_code, syn, comp, n, statuses, cfg):
    """Stepped reward of one response (restated from the survey's table)."""
    if not has_code:
        return cfg.format_penalty
    if not syn:
        return cfg.syntax_error_penalty
    if not comp:
        return cfg.compile_error_penalty
    if not statuses or n == 0:
        return cfg.execution_base_reward + 0.2
    passed = sum(s == "success" for s in statuses)
    timeouts = sum(s == "timeout" for s in statuses)
    rt = sum(s in ("error", "runtime_error") for s in statuses)
    r = cfg.execution_base_reward
    if timeouts > 0:
        r += cfg.timeout_penalty
    elif rt > 0 and passed == 0:
        r += cfg.runtime_error_penalty
    if passed > 0:
        r += passed / n * cfg.pass_rate_weight
    if passed == n:
        r += cfg.full_pass_bonus
    return r


RESPONSE = st.tuples(st.booleans(), st.booleans(), st.booleans(), st.integers(0, 4),
                     st.lists(st.sampled_from(["success", "error", "timeout", "runtime_error", "other"]), max_size=4))


@SETTINGS
@given(st.lists(RESPONSE, min_size=1, max_size=40))
def test_reward_matches_rules(spark, rows):
    from rewardframe.operators import reward as RW

    cfg = RW.RewardConfig()
    scored = spark.createDataFrame(
        [(i, h, s, c, n, 10) for i, (h, s, c, n, _) in enumerate(rows)],
        "sample_id long, has_code boolean, syntax_valid boolean, compile_valid boolean, n_tests int, code_length int",
    )
    outs = [(i, k, st_) for i, (_, _, _, _, sts) in enumerate(rows) for k, st_ in enumerate(sts)]
    outcomes = spark.createDataFrame(outs or [(-1, 0, "success")], "sample_id long, test_idx int, status string")
    got = {r.sample_id: r.reward for r in RW.score(scored, outcomes).collect()}
    for i, (h, s, c, n, sts) in enumerate(rows):
        assert abs(got[i] - _reward_py(h, h and s, h and s and c, n, sts, cfg)) < 1e-12, (i, rows[i])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 3), min_size=4, max_size=4), st.booleans()), min_size=1, max_size=40))
def test_verify_status_matches_rules(spark, rows):
    """n tests, successes per run (capped at n), solution present."""
    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(i, sol, n) for i, (n, _, sol) in enumerate(rows)], "sample_id long, has_solution boolean, n_tests int")
    outs = []
    for i, (n, per_run, sol) in enumerate(rows):
        for run, k in enumerate(per_run):
            for t in range(n):
                outs.append((i, run, t, "success" if t < min(k, n) else "error"))
    outcomes = spark.createDataFrame(outs or [(-1, 0, 0, "error")], "sample_id long, run long, test_idx long, status string")
    got = {r.sample_id: r.status for r in V.verify_results(samples, outcomes).collect()}
    for i, (n, per_run, sol) in enumerate(rows):
        if not sol:
            want = "no_solution"
        elif n == 0:
            want = "no_tests"
        else:
            rates = [min(k, n) / n for k in per_run]
            mean = sum(rates) / len(rates)
            stable = max(rates) - min(rates) < 0.1
            want = "pass" if mean >= 1.0 and stable else "partial" if mean >= 0.5 else "flaky" if not stable else "fail"
        assert got[i] == want, (i, rows[i])

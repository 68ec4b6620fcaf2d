"""End to end: samples -> execution plan -> runner (mapInPandas) -> classified outcomes ->
verification status and rewards. The runner here is a test helper that runs the generated
scripts with the local interpreter; the library itself ships no process launcher."""

import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F

from rewardframe.operators import reward as RW
from rewardframe.operators import verify as V


def _make_runner():
    """Defined in a closure so it is pickled by value (workers cannot import test modules)."""
    import subprocess
    import sys

    import pandas as pd

    def local_runner(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    p = subprocess.run([sys.executable, "-c", r.script], capture_output=True, text=True, timeout=r.timeout_s)
                    out.append((r.sample_id, r.run, r.test_idx, r.sentinel, p.returncode == 0, p.returncode, p.stdout, p.stderr, False, False, None))
                except subprocess.TimeoutExpired:
                    out.append((r.sample_id, r.run, r.test_idx, r.sentinel, False, None, "", "", True, False, None))
            yield pd.DataFrame(out, columns=["sample_id", "run", "test_idx", "sentinel", "ok", "returncode", "stdout", "stderr", "timed_out", "blocked", "error_type"])


    return local_runner


def test_verify_and_score_end_to_end(spark):
    add = "def add(a, b):\n    return a + b"
    rows = [
        (1, add, ["assert add(1, 2) == 3", "assert add(0, 0) == 0"]),
        (2, "def add(a, b):\n    return a - b", ["assert add(1, 2) == 3", "assert add(2, 2) == 4"]),
        (3, "import sys\nsys.exit(0)", ["assert True"]),
        (4, "while True:\n    pass", ["assert True"]),
        (5, "", ["assert True"]),
        (6, add, []),
        (7, "def add(a, b):\n    return a * b", ["assert add(0, 0) == 0", "assert add(1, 2) == 3"]),
    ]
    samples = spark.createDataFrame(rows, "sample_id long, solution string, tests array<string>")
    plan = V.plan_executions(samples, n_runs=2, timeout_s=2.0)
    assert plan.count() == (2 + 2 + 1 + 1 + 2) * 2
    raw = V.run_executions(plan, _make_runner(), num_partitions=4)
    outcomes = V.classify_outcomes(raw, ["sample_id", "run", "test_idx"]).cache()
    types = {(r.sample_id, r.error_type) for r in outcomes.where(F.col("run") == 0).collect()}
    assert (3, "INCOMPLETE_TEST_RUN") in types and (4, "TIMEOUT") in types and (2, "ASSERTION_ERROR") in types

    res = {r.sample_id: r.status for r in V.verify_results(samples, outcomes, n_runs=2).collect()}
    assert res == {1: "pass", 2: "fail", 3: "fail", 4: "fail", 5: "no_solution", 6: "no_tests", 7: "partial"}

    responses = samples.select(
        "sample_id",
        F.concat(F.lit("```python\n"), F.col("solution"), F.lit("\n```")).alias("response"),
        F.to_json("tests").alias("tests_text"),
    )
    scored = RW.score(RW.prepare_responses(responses), outcomes.where(F.col("run") == 0))
    got = {r.sample_id: r.reward for r in scored.collect()}
    assert got[1] == 3.0 and got[5] == -1.5
    assert abs(got[2] - (-0.2)) < 1e-9 and abs(got[6] - 0.2) < 1e-9 and got[7] == 1.0

"""Outcomes that arrive: two streams, several batches, restarts; equal to the batch result."""

import random

from pyspark.sql import functions as F

from rewardframe.operators import reward as RW
from rewardframe.operators import verify as V
from rewardframe.streaming import scoring as ST
from rewardframe.streaming.arrivals import score_arrivals

FLAGS = "sample_id string, has_code boolean, syntax_valid boolean, compile_valid boolean, n_tests int, code_length int"
OUTCOMES = "sample_id string, test_idx bigint, status string, error_type string, run_time_s double"


def some_rows(seed):
    rng = random.Random(seed)
    flags, outcomes = [], []
    for i in range(60):
        valid = rng.random() < 0.8
        tests = rng.choice([0, 1, 3, 20])
        flags.append((f"r{i}", valid or rng.random() < 0.5, valid, valid, tests, rng.randint(0, 90)))
        if valid:
            crash = rng.random() < 0.1
            for t in range(tests):
                ok = rng.random() < 0.7
                error = V.RUNNER_ERROR if crash else None if ok else rng.choice(["TIMEOUT", "ASSERTION_ERROR"])
                outcomes.append((f"r{i}", t, "success" if ok and not crash else "error", error, t / 4))
    return rng, flags, outcomes


def test_arrivals_equal_the_batch_result(spark, tmp_path):
    for timeout_as in ("error", "timeout"):
        base = tmp_path / timeout_as
        rng, flags, outcomes = some_rows(3)
        want = RW.score(spark.createDataFrame(flags, FLAGS), spark.createDataFrame(outcomes, OUTCOMES), timeout_as=timeout_as)
        again = rng.sample(outcomes, len(outcomes) // 3)
        rng.shuffle(flags)
        rng.shuffle(outcomes)
        for third in range(3):  # three starts of the query, two files of each stream before each
            for half in range(2):
                at = 2 * third + half
                spark.createDataFrame(flags[at::6], FLAGS).coalesce(1).write.mode("append").parquet(f"{base}/responses")
                mine = outcomes[at::6] + (again if at == 5 else again[at::6])
                spark.createDataFrame(mine, OUTCOMES).coalesce(1).write.mode("append").parquet(f"{base}/outcomes")
            streams = [ST.stream_from_files(spark, f"{base}/{x}", max_files_per_trigger=1) for x in ("responses", "outcomes")]
            scored = score_arrivals(*streams, timeout_as=timeout_as)
            ST.run_available(scored, f"{base}/out", f"{base}/checkpoint")
            if third == 0:
                # nothing is scored before its last outcome is in
                there = {x[0] for x in outcomes[0::6] + outcomes[1::6]}
                done = {r.sample_id for r in spark.read.parquet(f"{base}/out").collect()}
                whole = {f[0] for f in flags[0::6] + flags[1::6]}
                assert done <= whole and len(done) < len(flags) and there
        got = spark.read.parquet(f"{base}/out")
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_totals_over_three_files_and_a_restart(spark, tmp_path):
    """State of the totals is carried from batch to batch and over a restart between them (ST2)."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = RW.manager_stats(ST.score_stream(ST.event_flags(events))).first()
    seen = []
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part == 1:
            continue  # the second start finds two new files
        stream = ST.stream_from_files(spark, f"{tmp_path}/in", max_files_per_trigger=1)
        ST.run_available(ST.stats_stream(ST.score_stream(ST.event_flags(stream))), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "complete")
        seen.append(ST.latest_result(spark, f"{tmp_path}/out").first())
    assert seen[0].total_samples == events.where("event_id % 3 = 0").count()
    assert seen[1] == want


class Known:
    """A state as the function sees it."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_response_meets_its_outcomes_as_texts():
    """the state function gets one column of texts, whatever comes in."""
    import json

    import pandas as pd

    from rewardframe.streaming.arrivals import _meet

    def call(state, *rows):
        batches = iter([pd.DataFrame({"id": ["a"] * len(rows), "row": [json.dumps(r) for r in rows]})])
        return [r for out in _meet(("a",), batches, state) for r in out.to_dict("records")]

    flags = {"has_code": True, "syntax_valid": True, "compile_valid": True, "n_tests": 3}
    state = Known()
    assert call(state, {"test_idx": 1, "counts_as": 0, "crashed": False, "run_time_s": 0.5}, {"response": flags}) == []
    assert call(state, {"test_idx": 1, "counts_as": 2, "crashed": False}, {"test_idx": 9, "crashed": False}) == []
    (got,) = call(state, {"response": {}}, {"test_idx": 0, "counts_as": 1, "crashed": False, "run_time_s": "Infinity"})
    assert got == {
        "id": "a", **flags, "code_length": None, "passed_n": 1, "timeouts_n": 1, "runtime_errors_n": 0, "outcomes_n": 3, "crashed_n": 0,
        "execution_time": float("inf"),
    }
    assert call(state, {"response": flags}, {"test_idx": 2, "counts_as": 0, "crashed": False}) == []


def test_odd_outcomes_equal_the_batch_result(spark, tmp_path):
    """null and unknown statuses, run times that are no number, null flags, ids with quotes, a null id."""
    flags = [('q"\n', True, True, True, 4, 9), ("é", True, True, True, 1, None), ("n", None, None, None, None, None), (None, False, None, True, 0, 3)]
    outcomes = [
        ('q"\n', 0, None, None, 0.1), ('q"\n', 1, "other", None, None), ('q"\n', 2, "timeout", None, float("nan")),
        ('q"\n', 40, "runtime_error", "x", 1e-300), ("é", 0, "error", "TIMEOUT", 0.1 + 0.2),
    ]
    frames = {"responses": spark.createDataFrame(flags, FLAGS), "outcomes": spark.createDataFrame(outcomes, OUTCOMES)}
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    streams = [ST.stream_from_files(spark, f"{tmp_path}/{x}") for x in frames]
    ST.run_available(score_arrivals(*streams, timeout_as="timeout"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out")
    known = frames["outcomes"].withColumn("run_time_s", F.nanvl("run_time_s", F.lit(None)))
    want = RW.score(frames["responses"], known, timeout_as="timeout").where("sample_id is not null")
    columns = sorted(c for c in want.columns if c != "sample_id")
    assert got.where("sample_id is null").count() == 1
    rows = lambda df: sorted(map(tuple, df.where("sample_id is not null").select("sample_id", *columns).collect()), key=repr)
    assert rows(got) == rows(want)

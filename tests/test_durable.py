"""What survives a crash: execution logs and published versions; rank search and quantiles of odd data."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rewardframe.operators import profile as PF
from rewardframe.operators import sampling as SM
from rewardframe.operators import verify as V
from rewardframe.sources import readers as RD
from rewardframe.sources import sinks as SK

SAMPLES = "sample_id string, solution string, tests array<string>"


def runner(log, crash_file):
    """Notes each execution in a file of its own task; while ``crash_file`` exists, one test kills its task."""

    def run(batches):
        for batch in batches:
            done = []
            for r in batch.itertuples():
                if r.sample_id == "s13" and os.path.exists(crash_file):
                    raise RuntimeError("the runner's machine is gone")
                done.append(f"{r.sample_id} {r.run} {r.test_idx}\n")
            with open(f"{log}/{os.getpid()}-{random.random()}", "w") as f:
                f.writelines(done)
            yield batch[["sample_id", "run", "test_idx", "sentinel"]].assign(
                ok=True, returncode=0, stdout=batch["sentinel"], stderr="", timed_out=False, blocked=False, error_type=None
            )

    return run


def test_a_run_that_is_repeated_executes_no_finished_test_twice(spark, tmp_path):
    ran, crash, log = tmp_path / "ran", tmp_path / "crash", str(tmp_path / "log")
    ran.mkdir()
    crash.touch()
    samples = spark.createDataFrame([(f"s{i}", f"x = {i}", [f"assert {j}" for j in range(i % 4)]) for i in range(30)], SAMPLES)
    plan = V.plan_executions(samples, n_runs=3)
    run = runner(str(ran), str(crash))

    def executed():
        return sorted(x for f in ran.iterdir() for x in f.read_text().splitlines())

    with pytest.raises(Exception, match="machine is gone"):
        V.resume_executions(plan, run, log, commit_rows=5)
    committed = spark.read.parquet(log).count() if any(p.startswith("part") for p in os.listdir(log)) else 0
    before = executed()
    assert 0 < committed < plan.count()
    crash.unlink()
    outcomes = V.resume_executions(plan, run, log, commit_rows=5)
    assert outcomes.count() == plan.count() == outcomes.select("sample_id", "run", "test_idx").distinct().count()
    after = executed()
    twice = len(after) - len(set(after))
    # what had ended but was in no committed task is the only work done again
    assert twice <= len(before) - committed
    assert spark.read.parquet(log).count() == plan.count()
    # nothing is left to do
    V.resume_executions(plan, run, log)
    assert executed() == after
    # another solution is another script: only its tests are run
    changed = samples.withColumn("solution", F.when(F.col("sample_id") == "s7", "x = 70").otherwise(F.col("solution")))
    again = V.resume_executions(V.plan_executions(changed, n_runs=3), run, log)
    assert again.count() == plan.count() and len(executed()) == len(after) + 9
    # the job takes the log, too
    from rewardframe.operators import jobs as J

    counts = {r.status: r.n for r in J.verify_job(changed, str(tmp_path / "out"), runner=run, n_runs=3, log_path=log).collect()}
    assert counts["pass"] == 22 and len(executed()) == len(after) + 9
    assert V.resume_executions(plan.limit(0), run, str(tmp_path / "no-log")).count() == 0


def test_a_published_path_is_readable_at_every_instant(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out.parquet")
    fs, _ = SK._fs(spark, path)

    def there():
        return sorted(r.id for r in RD.read_any(spark, path).collect())

    spark.range(3).coalesce(1).write.parquet(path)  # a plain output from before
    state = there()
    steps = ["write_dataset", "current_version", "_drop_old"]
    for number in range(1, 5):
        new = list(range(10 * number, 10 * number + 3))
        df = spark.range(new[0], new[-1] + 1).coalesce(1)
        for step in steps:
            whole = getattr(SK, step)
            calls = []

            def crash(*args, whole=whole, step=step, calls=calls, **kwargs):
                calls.append(1)
                if step == "current_version" and len(calls) == 1:
                    return whole(*args, **kwargs)
                if step == "write_dataset":
                    whole(*args, **kwargs)
                raise RuntimeError("crash")

            monkeypatch.setattr(SK, step, crash)
            with pytest.raises(RuntimeError, match="crash"):
                SK.publish(df, path)
            monkeypatch.undo()
            # before the pointer the old rows, after it the new ones
            state = new if step == "_drop_old" else state
            assert there() == state
        # the input may be the output
        SK.publish(RD.read_any(spark, path).union(spark.range(1)), path)
        state = sorted([*new, 0])
        assert there() == state
        versions = os.listdir(f"{path}/{SK.VERSIONS}")
        assert len([v for v in versions if "-" in v and not v.startswith(".")]) <= 3
    assert not [f for f in os.listdir(path) if f.startswith("part-")]


def test_token_filter_publishes(spark, tmp_path):
    from rewardframe.operators import jobs as J

    path = str(tmp_path / "docs.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(path)
    for limit in (800, 500):  # the input is the output, twice
        got = J.token_filter_job(RD.read_any(spark, path), "text", limit, path, publish=True)
        want = J.token_filter_job(docs, "text", limit, str(tmp_path / f"plain{limit}"))
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    assert 0 < got.count() < docs.count()


def test_only_one_of_two_publishers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out.parquet")
    SK.publish(spark.range(1), path)
    whole = SK.write_dataset

    def slow(df, to, fmt="parquet"):
        monkeypatch.undo()
        SK.publish(spark.range(2), path)  # another job comes first
        whole(df, to, fmt)

    monkeypatch.setattr(SK, "write_dataset", slow)
    with pytest.raises(OSError, match="meanwhile"):
        SK.publish(spark.range(3), path)
    assert RD.read_any(spark, path).count() == 2


@pytest.mark.parametrize("n", [0, 1, 7, 399, 400, 401, 777, 900, 1150, 1200])
def test_ranks_inside_one_id(spark, monkeypatch, n):
    """A third of the rows have one id, a third none; of these many are equal."""
    monkeypatch.setattr(SM, "BOUNDARY_ROWS", 10)
    rows = [("hot", i) for i in range(300)] + [("hot", 7)] * 100 + [(None, i % 3) for i in range(400)] + [(f"id{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, x int").repartition(5)
    got = SM.first_n_by_key(df, n, "id").collect()
    keyed = SM._keyed(df, "id", SM.DEFAULT_SEED).collect()
    order = sorted((r._key, r._row) for r in keyed)
    assert len(got) == n
    kept = SM._keyed(spark.createDataFrame(got, df.schema), "id", SM.DEFAULT_SEED).collect() if got else []
    assert sorted((r._key, r._row) for r in kept) == order[:n]
    train, val = SM.split_exact(df, "id", n / 1200)
    assert (train.count(), val.count()) == (int(1200 * (n / 1200)), 1200 - int(1200 * (n / 1200)))


def quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    a, b = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return a if a == b else a + (b - a) * (at - int(at))


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "wide", "one", "integers"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(PF, "SORTED_ROWS", 20)
    monkeypatch.setattr(PF, "ACCURACY", 100)
    rng = random.Random(3)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(2000)] + [rng.random() for _ in range(500)],
        "two": [1.0] * 999 + [2.0] * 1001,
        "wide": [math.exp(rng.uniform(-600, 600)) * rng.choice([-1, 1]) for _ in range(3000)],
        "one": [5.5],
        "integers": [rng.randint(-(10**12), 10**12) for _ in range(2500)],
    }[kind]
    schema = "x bigint" if kind == "integers" else "x double"
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], schema).repartition(4)
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = PF.exact_quantiles(df, "x", probabilities)
    assert got == pytest.approx([quantile(values, p) for p in probabilities], rel=1e-12)
    row = PF.describe_values(df, "x").first()
    assert row["count"] == len(values) and row["p50"] == pytest.approx(statistics.median(values), rel=1e-12)


def test_ranks_of_other_types_and_no_values(spark):
    days = spark.sql("select date_add(date'2020-01-01', cast(pmod(id * 7919, 5000) as int)) as d from range(5000)")
    assert [str(d) for d in PF.ranked_values(days, "d", [0, 2500, 4999])] == ["2020-01-01", "2026-11-05", "2033-09-08"]
    none = spark.createDataFrame([(None,)], "x double")
    assert PF.exact_quantiles(none, "x", [0.5]) == [None]
    assert PF.describe_values(none, "x").first()["p50"] is None


def dealt(monkeypatch, call):
    """The rows that a call would run, as it deals them to its tasks."""
    seen = []
    old = V._resumed
    monkeypatch.setattr(V, "_resumed", lambda hashed, deal, *rest: seen.append((hashed, deal)) or old(hashed, deal, *rest))
    call()
    monkeypatch.undo()
    return seen[0]


@pytest.mark.parametrize("whole", [True, False])
def test_scripts_are_shuffled_once_and_not_sorted(spark, tmp_path, monkeypatch, whole):
    """what the log holds is found where the code is dealt to, with one exchange of it."""
    rows = [(f"s{i}" if i else None, f"x = {i}", [f"assert {j}" for j in range(i % 12)] + [None] * (i % 7 == 1)) for i in range(30)]
    samples = spark.createDataFrame(rows, SAMPLES)
    plan = V.plan_executions(samples, n_runs=11)
    run = runner(str(tmp_path), str(tmp_path / "none"))
    if whole:
        hashed, deal = dealt(monkeypatch, lambda: V.resume_executions(plan, run, str(tmp_path / "log")))
    else:
        hashed, deal = dealt(monkeypatch, lambda: V.resume_samples(samples, run, str(tmp_path / "log"), 11))
    keys = ["sample_id", "run", "test_idx", "script_hash"]
    want = plan.withColumn("script_hash", F.sha2("script", 256))
    ordered = lambda df: sorted(df.select(*keys, "script", "sentinel", "timeout_s").collect(), key=repr)
    assert ordered(hashed) == ordered(want) == ordered(deal(None, 3))
    other = F.when(F.col("sample_id") == "s7", "another").otherwise(F.col("script_hash"))
    log = want.where("run < 2 or run = 9").withColumn("script_hash", other).select(*keys)
    todo = deal(log, 4)
    lines = todo._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("SortMergeJoin" in x or "Sort [" in x for x in lines)
    assert sum("Exchange" in x for x in lines) == 2 and todo.rdd.getNumPartitions() == 4
    assert ordered(todo) == ordered(want.join(log, keys, "left_anti"))


def test_no_task_is_held_by_one_id(spark, tmp_path, monkeypatch):
    samples = spark.createDataFrame([("a", "x = 1", [f"assert {j}" for j in range(200)])], SAMPLES)
    run = runner(str(tmp_path), str(tmp_path / "none"))
    for i, call in enumerate((V.resume_samples, lambda s, *a: V.resume_executions(V.plan_executions(s), *a))):
        _, deal = dealt(monkeypatch, lambda: call(samples, run, str(tmp_path / f"log{i}")))
        parts = deal(None, 4).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r[1] for r in parts) < 500

"""Log files read as a source."""

import random

import pytest

from rewardframe.sources.logs import marked_lines, read_eval_logs


@pytest.fixture
def split_size(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def use(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_the_line_after_a_marker_may_be_in_the_next_split(spark, tmp_path, split_size, size):
    split_size(size)
    rng = random.Random(size)
    want = []
    for i in range(6):
        lines = [rng.choice(["@x@", "a @x@ b", "", "chatter " * rng.randint(0, 9), "@y@@x@"]) for _ in range(rng.randint(0, 30))]
        (tmp_path / f"f{i}.log").write_text("\n".join(lines) + rng.choice(["", "\n"]))
        lines = lines[:-1] if lines and lines[-1] == "" else lines
        want += [(f"f{i}.log", m, a, b) for a, b in zip(lines, [*lines[1:], None]) for m in ("@x@", "@y@") if m in a]
    got = [(r.file.rsplit("/", 1)[-1], r.marker, r.line, r.after) for r in marked_lines(spark, str(tmp_path), ["@x@", "@y@"]).collect()]

    def text(rows):
        return sorted(((f, m, a, b or "") for f, m, a, b in rows))

    assert text(got) == text(want)


def test_scores_of_models_and_benchmarks(spark, tmp_path, split_size):
    split_size(30)
    logs = {
        "m1/humaneval.log": "start\nhumaneval (base tests)\npass@1:\t0.85\nhumaneval+ (base + extra tests)\npass@1:\t0.80\n",
        "m1/mbpp.log": "mbpp (base tests) PASS@1: 0.7 x\nrest\n(base + extra tests)\nno score\npass@1 0.1",
        "m2/humaneval.log": "crash\n",
        "m2/mbpp.log": "(base tests)\npass@1: 0.5\n(base tests)\npass@1: 0.9",
        "m3/mbpp.log": "\n",
    }
    for name, text in logs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    codes = spark.createDataFrame([("m2", "humaneval", 1), ("m1", "mbpp", 0), ("m9", "mbpp", 0)], "model string, benchmark string, exit_code int")
    got = {(r.model, r.benchmark): (r.base_score, r.plus_score) for r in read_eval_logs(spark, str(tmp_path), codes).collect()}
    assert got == {
        ("m1", "humaneval"): ("0.85", "0.80"), ("m1", "mbpp"): ("(base", "N/A"), ("m2", "humaneval"): ("Error", "Error"),
        ("m2", "mbpp"): ("0.5", "N/A"), ("m3", "mbpp"): ("N/A", "N/A"), ("m9", "mbpp"): ("N/A", "N/A"),
    }
    assert len(read_eval_logs(spark, str(tmp_path)).collect()) == 5

"""End-to-end dataset jobs on small inputs derived from the test tables."""

import glob
import hashlib
import json
import os
import tempfile

from pyspark.sql import functions as F

from rewardframe.operators import jobs as J
from rewardframe.plans.fixtures import fixture
from rewardframe.session import table

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="rf-job-")


def test_verify_job_with_outcomes(spark):
    samples = fixture(spark, SF, "fx_samples")
    verdicts = fixture(spark, SF, "fx_verdicts")
    out = _tmp()
    counts = {r.status: r.n for r in J.verify_job(samples, out, outcomes=verdicts).collect()}
    assert counts["pass"] == 32 and counts["Total"] == 125
    kept = spark.read.json(f"{out}/kept")
    assert kept.count() == 32
    rep = spark.read.json(f"{out}/report").first()
    assert rep["total"] == 125 and rep["kept"] == 32
    assert spark.read.parquet(f"{out}/results").count() == 125


def test_convert_job_jsonl(spark):
    base = _tmp()
    src = f"{base}/in.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"question": "q1", "code": "x=1", "test_cases": ["assert x == 1"], "meta": 5}) + "\n")
        f.write("not json\n")
        f.write(json.dumps({"prompt": "  ", "problem": "p2", "solution": "", "tests": "[\"a\", \"b\"]", "index": 9}) + "\n")
    report = J.convert_job(spark, src, f"{base}/out", "parquet").first()
    assert report["total"] == 2 and report["with_solution"] == 1 and report["avg_tests"] == 1.5
    rows = {r["prompt"]: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert rows["q1"]["extra_info"]["index"] == 0 and rows["q1"]["extra_info"]["extra"]["meta"] == "5"
    assert rows["p2"]["extra_info"]["index"] == 9 and list(rows["p2"]["reward_model"]["ground_truth"]) == ["a", "b"]


def test_split_job(spark):
    base = _tmp()
    d = table(spark, SF, "documents").select("doc_id", "lang")
    J.split_job(d, "doc_id", f"{base}/train", f"{base}/val", 0.9)
    key = lambda r: hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()
    for part in ("train", "val"):  # files in name order hold the rows in the shuffled order
        rows = [json.loads(line) for f in sorted(glob.glob(f"{base}/{part}/part-*")) for line in open(f)]
        assert len(rows) > 1 and rows == sorted(rows, key=key)
    tr = spark.read.json(f"{base}/train")
    va = spark.read.json(f"{base}/val")
    assert tr.count() == int(d.count() * 0.9) and tr.count() + va.count() == d.count()
    assert tr.join(va, "doc_id").count() == 0


def test_sft_job(spark):
    base = _tmp()
    s = fixture(spark, SF, "fx_sft").withColumn("sid", F.concat_ws(":", "conv_id", "turn"))
    funnel = {r.reason: r.n for r in J.sft_job(s, "instruction", "output", "sid", f"{base}/sft", max_samples=5, max_total_chars=1200, min_output_chars=200).collect()}
    msgs = spark.read.json(f"{base}/sft")
    assert msgs.count() == funnel["accepted"] == 5
    assert [m["role"] for m in msgs.first()["messages"]] == ["system", "user", "assistant"]


def test_token_filter_job_replace(spark):
    base = _tmp()
    path = f"{base}/docs"
    table(spark, SF, "documents").select("doc_id", "text").write.parquet(path)
    src = spark.read.parquet(path)
    returned = J.token_filter_job(src, "text", 500, path, replace=True)
    got = spark.read.parquet(path)
    assert returned.count() == got.count()
    assert got.count() > 0 and got.count() < table(spark, SF, "documents").count()
    assert os.path.isdir(path)


def test_sft_job_aliases_and_no_limit(spark):
    base = _tmp()
    rows = [(i, "" if i % 2 else f"q{i}", f"p{i}", "out") for i in range(30)] + [(99, "", "", "out")]
    df = spark.createDataFrame(rows, "id long, instruction string, prompt string, output string")
    funnel = {r.reason: r.n for r in J.sft_job(df, ["instruction", "prompt"], "output", "id", f"{base}/sft").collect()}
    assert funnel == {"accepted": 30, "empty": 1}
    lines = [json.loads(x) for f in sorted(glob.glob(f"{base}/sft/part-*")) for x in open(f)]
    order = sorted(range(30), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert [m["messages"][1]["content"] for m in lines] == [f"p{i}" if i % 2 else f"q{i}" for i in order]


def test_convert_job_rejects_and_index(spark):
    base = _tmp()
    for name, lines in (("b", ["5", '"txt"', "[1]", "null", '{"prompt": "b", "index": "a-1"}']), ("a", ['{"prompt": "a0"}'] * 40)):
        os.makedirs(f"{base}/in", exist_ok=True)
        with open(f"{base}/in/{name}.jsonl", "w") as f:
            f.write("\n".join(lines) + "\n")
    report = J.convert_job(spark, f"{base}/in", f"{base}/out", "json", input_format="jsonl", rejects_path=f"{base}/rejects").first()
    assert (report["total"], report["rejected"]) == (41, 4)
    reasons = sorted(r.reason for r in spark.read.json(f"{base}/rejects").collect())
    assert reasons == ["not an object: array", "not an object: bigint", "not an object: string", "not an object: void"]
    rows = [r for f in glob.glob(f"{base}/out/part-*") for r in json.load(open(f))]
    b = next(r for r in rows if r["prompt"] == "b")
    assert b["extra_info"]["index"] == 44 and b["extra_info"]["extra"] == {"index": '"a-1"'}
    assert sorted(r["extra_info"]["index"] for r in rows if r["prompt"] == "a0") == list(range(40))


def test_verify_job_with_runner_and_other_id(spark):
    """A runner over the plan, with ids of another name and of type string."""
    import pandas as pd

    def runner(batches):
        for pdf in batches:
            n = len(pdf)
            made = {"ok": True, "returncode": 0, "stdout": pdf.sentinel, "stderr": "", "timed_out": False, "blocked": False, "error_type": None}
            yield pd.concat([pdf[["task", "run", "test_idx", "sentinel"]], pd.DataFrame(made, index=pdf.index)], axis=1) if n else pdf

    samples = spark.createDataFrame([("a", "x = 1", ["t", "u"]), ("b", "", ["t"])], "task string, solution string, tests array<string>")
    counts = {r.status: r.n for r in J.verify_job(samples, _tmp(), runner=runner, id_col="task").collect()}
    assert counts == {"pass": 1, "no_solution": 1, "Total": 2}

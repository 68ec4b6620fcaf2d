"""Sampling, splitting, funnel and index properties; readers and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rewardframe.operators import convert as CV
from rewardframe.operators import sampling as SM
from rewardframe.session import table
from rewardframe.sources import readers as RD

SF = "/root/testdata/sf0.001"


def test_split_exact_disjoint_complete(spark):
    d = table(spark, SF, "documents").select("doc_id")
    train, val = SM.split_exact(d, "doc_id", 0.95, 42)
    t = {r[0] for r in train.collect()}
    v = {r[0] for r in val.collect()}
    all_ids = {r[0] for r in d.collect()}
    assert t.isdisjoint(v) and t | v == all_ids
    assert len(t) == int(len(all_ids) * 0.95)


def test_shuffle_key_independent_of_partitioning(spark):
    d = table(spark, SF, "documents").select("doc_id")
    a = {r[0] for r in SM.first_n_by_key(d, 37, "doc_id").collect()}
    b = {r[0] for r in SM.first_n_by_key(d.repartition(7), 37, "doc_id").collect()}
    assert a == b and len(a) == 37


def test_first_n_beyond_data(spark):
    d = table(spark, SF, "documents").select("doc_id")
    assert SM.first_n_by_key(d, 10**9, "doc_id").count() == d.count()
    assert SM.first_n_by_key(d, 0, "doc_id").count() == 0


def test_funnel_sums_to_scanned(spark):
    funnel = {r["reason"]: r["n"] for r in entry.queries()["sft_sample_funnel"](spark, SF).collect()}
    sample = entry.queries()["sft_sample"](spark, SF).count()
    assert funnel.get("accepted", 0) == sample
    full = {r["reason"]: r["n"] for r in entry.queries()["sft_funnel"](spark, SF).collect()}
    assert sum(funnel.values()) <= sum(full.values())


def test_dense_index_any_bucket_count(spark):
    d = table(spark, SF, "documents").select("doc_id")
    for nb in (1, 3, 16):
        idx = SM.dense_index(d, "doc_id", "i", n_parts=nb)
        rows = sorted((r["doc_id"], r["i"]) for r in idx.collect())
        assert [i for _, i in rows] == list(range(len(rows)))


def test_surrogate_scrub(spark):
    lines = ['{"a": "x\\ud800y"}', '{"a": "\\ud83d\\ude00"}', '{"a": "\\\\ud800"}']
    df = spark.createDataFrame([(s,) for s in lines], "raw string")
    got = [r[0] for r in df.select(F.try_variant_get(F.try_parse_json(RD.scrub_surrogates("raw")), "$.a", "string")).collect()]
    assert got == ["xy", "\U0001F600", "\\ud800"]


def test_json_document_shapes(spark):
    base = tempfile.mkdtemp(prefix="rf-json-")
    docs = {
        "a.json": [{"id": 1}, {"id": 2}],
        "b.json": {"meta": 1, "items": [{"id": 3}]},
        "c.json": {"data": [], "id": 4},
    }
    for name, obj in docs.items():
        d = os.path.join(base, name.split(".")[0])
        os.makedirs(d)
        with open(os.path.join(d, name), "w") as f:
            json.dump(obj, f)
    got = sorted(r[0] for r in RD.read_json_document(spark, base + "/*").select(F.try_variant_get("v", "$.id", "int")).collect())
    assert got == [1, 2, 3, 4]


def test_read_any_rejects_unknown_suffix(spark):
    import pytest

    with pytest.raises(ValueError):
        RD.read_any(spark, "/nowhere/file.csv")


def test_prompt_text(spark):
    vals = ['"  hi  "', '{"content": " c ", "text": "t"}', '{"question": "q"}', '{"x": 1}', "[1, 2]"]
    df = spark.createDataFrame([(v,) for v in vals], "s string").select(RD.prompt_text(F.parse_json("s")).alias("p"))
    assert [r[0] for r in df.collect()] == ["hi", "t", "q", '{"x":1}', "[1,2]"]


def test_read_strict_fails_on_bad_line(spark):
    import pytest

    base = tempfile.mkdtemp(prefix="rf-strict-")
    with open(os.path.join(base, "a.jsonl"), "w") as f:
        f.write('{"id": "1", "solution": "x", "tests": ["t"]}\n\n{"id": "2", "solution": "y", "tests": []}\n')
    ok = RD.read_strict(spark, base, "id string, solution string, tests array<string>")
    assert ok.count() == 2
    with open(os.path.join(base, "b.jsonl"), "w") as f:
        f.write("{not json\n")
    with pytest.raises(Exception):
        RD.read_strict(spark, base, "id string, solution string, tests array<string>").count()


def test_replace_path_swaps_output(spark):
    from rewardframe.sources import sinks as SK

    base = tempfile.mkdtemp(prefix="rf-sink-")
    out = os.path.join(base, "out")
    spark.range(3).write.parquet(out)
    SK.replace_path(spark.range(10), out)
    assert spark.read.parquet(out).count() == 10


def _runs(spark, per_run):
    outs = [(1, run, t, "success" if ok else "error") for run, ok in enumerate(per_run) for t in range(2)]
    return spark.createDataFrame(outs, "sample_id long, run long, test_idx long, status string")


def test_verify_results_counts_the_runs_present(spark):
    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(1, True, 2), (2, True, 2)], "sample_id long, has_solution boolean, n_tests int")
    ten = V.verify_results(samples, _runs(spark, [True] * 4 + [False] * 6)).collect()
    assert {r.sample_id: (r.status, r.pass_rate, r.stable) for r in ten} == {1: ("flaky", 0.4, False), 2: ("fail", 0.0, True)}
    three = {r.sample_id: r for r in V.verify_results(samples, _runs(spark, [True] * 3)).collect()}
    assert (three[1].status, three[1].pass_rates, three[2].pass_rates) == ("pass", [1.0, 1.0, 1.0], [])


def test_verify_results_checks_the_number_of_runs(spark):
    import pytest

    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(1, True, 2)], "sample_id long, has_solution boolean, n_tests int")
    assert V.verify_results(samples, _runs(spark, [True] * 3), n_runs=3).first().status == "pass"
    with pytest.raises(Exception, match="expected 4 runs of sample 1, found 3"):
        V.verify_results(samples, _runs(spark, [True] * 3), n_runs=4).collect()


def test_white_space_solution_is_run(spark):
    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(1, " ", ["t"]), (2, "", ["t"]), (3, None, ["t"])], "sample_id long, solution string, tests array<string>")
    assert [r.sample_id for r in V.plan_executions(samples, 1).collect()] == [1]
    none = spark.createDataFrame([], "sample_id long, run long, test_idx long, status string")
    assert {r.sample_id: r.status for r in V.verify_results(samples, none).collect()} == {1: "fail", 2: "no_solution", 3: "no_solution"}


def test_pluggable_tokenizer(spark):
    from rewardframe.functions.tokens import tokenizer_counter

    counter = tokenizer_counter(str.split)
    df = spark.createDataFrame([("a b  c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(counter("t")).collect()] == [3, 0, 0]


def test_json_arrays(spark):
    """Every file is one array, whatever the number of rows; empty tables give empty arrays."""
    import glob

    from rewardframe.sources import sinks as SK

    base = tempfile.mkdtemp(prefix="rf-arr-")
    df = spark.range(5).repartition(3).withColumn("x", F.when(F.col("id") > 2, F.lit('a"b\nc')))
    SK.write_json_array(df, f"{base}/many")
    SK.write_json_array(df.limit(0), f"{base}/none")
    SK.write_results(df, f"{base}/one")
    read = lambda name: [json.load(open(f)) for f in glob.glob(f"{base}/{name}/part-*")]
    assert sorted(r["id"] for a in read("many") for r in a) == [0, 1, 2, 3, 4]
    assert {r["x"] for a in read("many") for r in a} == {None, 'a"b\nc'}
    assert sum(read("none"), []) == [] and len(read("one")) == 1


def test_corrupt_json_document_raises(spark):
    import pytest

    base = tempfile.mkdtemp(prefix="rf-corrupt-")
    for name, text in {"a.json": '[{"id": 1}]', "b.json": "{not json", "c.json": '{"data": [], "items": [{"id": 2}], "id": 3}'}.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="not a JSON document.*b.json"):
        RD.read_json_document(spark, base).collect()
    got = RD.read_json_document(spark, f"{base}/[ac].json").select(F.try_variant_get("v", "$.id", "int")).collect()
    assert sorted(r[0] for r in got) == [1, 3]


def test_file_order_over_files_of_every_size(spark):
    """The index follows file names and lines, not the order in which Spark reads the splits."""
    base = tempfile.mkdtemp(prefix="rf-order-")
    want = []
    for name, n in (("a", 3), ("b", 4000), ("c", 1)):
        with open(f"{base}/{name}.jsonl", "w") as f:
            for i in range(n):
                f.write(json.dumps({"key": f"{name}{i}", "pad": "x" * 50}) + "\n\nnot json\n")
                want.append(f"{name}{i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = SM.index_in_file_order(RD.read_any(spark, base, "jsonl")).select("index", F.try_variant_get("v", "$.key", "string").alias("key")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.key for r in sorted(rows)] == want


def test_parquet_file_order(spark):
    base = tempfile.mkdtemp(prefix="rf-pq-") + "/in"
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(base)
    rows = SM.index_in_file_order(RD.read_any(spark, base, "parquet", origin=True)).collect()
    assert all(r["id"] == r["index"] for r in rows) and len(rows) == 1000


def test_exact_with_repeated_ids(spark):
    df = spark.createDataFrame([(i // 20, i % 3) for i in range(100)], "id long, x long").repartition(5)
    train, val = SM.split_exact(df, "id", 0.55)
    assert (train.count(), val.count()) == (55, 45)
    both = sorted(map(tuple, train.collect() + val.collect()))
    assert both == sorted(map(tuple, df.collect()))
    assert SM.first_n_by_key(df, 15, "id").count() == 15
    same = spark.createDataFrame([(1, 1)] * 40, "id long, x long")
    assert SM.split_exact(same, "id", 0.3)[0].count() == 12


def test_small_boundary_buckets(spark, monkeypatch):
    d = table(spark, SF, "documents").select("doc_id")
    whole = {r[0] for r in SM.first_n_by_key(d, 37, "doc_id").collect()}
    monkeypatch.setattr(SM, "BOUNDARY_ROWS", 1)
    monkeypatch.setattr(SM, "PREFIX_HEX", 1)
    assert {r[0] for r in SM.first_n_by_key(d, 37, "doc_id").collect()} == whole


def test_failed_replace_keeps_the_old_data(spark, monkeypatch):
    import pytest

    from rewardframe.sources import sinks as SK

    out = tempfile.mkdtemp(prefix="rf-swap-") + "/out"
    spark.range(3).write.parquet(out)
    real = SK._fs

    class Stuck:
        """A file system whose second move (new data in) fails."""

        def __init__(self, fs):
            self.fs, self.moves = fs, 0

        def exists(self, p):
            return self.fs.exists(p)

        def rename(self, a, b):
            self.moves += 1
            return False if self.moves == 2 else self.fs.rename(a, b)

    held = {}

    def stuck(spark, path):
        fs, p = real(spark, path)
        return held.setdefault("fs", Stuck(fs)), p

    monkeypatch.setattr(SK, "_fs", stuck)
    with pytest.raises(OSError, match="could not move"):
        SK.replace_path(spark.range(10), out)
    assert spark.read.parquet(out).count() == 3


def test_position_ids_and_splits(spark):
    d = table(spark, SF, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("id"), "doc_id")
    got = {r.doc_id: r.id for r in SM.with_position_id(d, "id", "doc_id").collect()}
    assert all(got[k] == str(k) for k in got)  # position of doc k is k (ids 0..n-1)
    base = tempfile.mkdtemp(prefix="rf-splits-")
    table(spark, SF, "region").write.parquet(f"{base}/train.parquet")
    table(spark, SF, "region").write.parquet(f"{base}/test.parquet")
    both = RD.read_splits(spark, {"train": f"{base}/train.parquet", "test": f"{base}/test.parquet"})
    assert {r.split for r in both.select("split").distinct().collect()} == {"train", "test"}


def test_write_verify_report(spark):
    from rewardframe.operators import verify as V
    from rewardframe.plans.fixtures import fixture

    s = fixture(spark, SF, "fx_samples")
    res = V.verify_results(s, fixture(spark, SF, "fx_verdicts"))
    base = tempfile.mkdtemp(prefix="rf-report-")
    V.write_verify_report(V.verify_report(res, ("pass", "partial")), res, base)
    rep = spark.read.json(f"{base}/report").first()
    assert rep.total == 125 and rep.kept == 32 + 24 and rep.filter_status == ["pass", "partial"]
    assert rep.status_counts["no_tests"] == 12


def test_missing_input_raises(spark):
    import pytest
    from pyspark.errors import AnalysisException

    for fmt in ("jsonl", "json", "parquet"):
        with pytest.raises(AnalysisException):
            RD.read_any(spark, f"/nonexistent/dir/input.{fmt}").count()


def test_mean_of_run_rates_is_exact(spark):
    """Rates 0, 2/3, 1, 1/3 average to exactly 0.5 ('partial'); a left-to-right double sum
    would give 0.49999999999999994 and 'flaky'."""
    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(1, True, 3)], "sample_id long, has_solution boolean, n_tests int")
    outs = [(1, run, t, "success" if t < k else "error") for run, k in enumerate([0, 2, 3, 1]) for t in range(3)]
    outcomes = spark.createDataFrame(outs, "sample_id long, run long, test_idx long, status string")
    for n_runs in (4, None):
        row = V.verify_results(samples, outcomes, n_runs=n_runs).first()
        assert row.status == "partial" and row.pass_rate == 0.5


def test_runner_error_status(spark):
    from rewardframe.operators import verify as V

    samples = spark.createDataFrame([(1, True, 1), (2, True, 1)], "sample_id long, has_solution boolean, n_tests int")
    outs = [(1, r, 0, "success", None) for r in range(4)] + [(2, 0, 0, "error", V.RUNNER_ERROR)]
    outcomes = spark.createDataFrame(outs, "sample_id long, run long, test_idx long, status string, error_type string")
    for n_runs in (4, None):
        got = {r.sample_id: (r.status, r.pass_rate, r.stable) for r in V.verify_results(samples, outcomes, n_runs=n_runs).collect()}
        assert got == {1: ("pass", 1.0, True), 2: ("error", 0.0, False)}


def test_split_edge_ratios(spark):
    d = table(spark, SF, "documents").select("doc_id")
    n = d.count()
    for ratio, want in ((0.0, 0), (1.0, n), (0.5, int(n * 0.5))):
        train, val = SM.split_exact(d, "doc_id", ratio)
        assert train.count() == want and val.count() == n - want


def test_alias_columns_of_any_type(spark, tmp_path):
    """Values are chosen by presence and keep their kind, whatever types the alias columns have."""
    schema = "prompt string, input bigint, question array<string>, description struct<content string, n int>, problem map<int, string>, code binary, answer double, tests string, checks array<struct<a int>>, index string, day date"
    rows = [
        ("  ", 7, [], None, {}, None, float("nan"), None, None, None, None),
        (None, None, ["a", None], None, None, b"print(1)", None, '["x"]', None, "4", None),
        (None, 3, None, ("hi", 1), None, b"\xff\x00", 1.5, "t", None, None, None),
        ("p", 0, None, None, None, b"", None, None, [(1,), (2,)], "zz", None),
        (None, None, None, None, {1: "one"}, None, None, "", [], None, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("_row", F.monotonically_increasing_id())
    good, rejects = CV.convertible_rows(df, ["_row"])
    assert [(r.reason, "tests" in r.raw) for r in rejects.collect()] == [("no text: solution is binary", True)]
    got = [
        (r.prompt, r.extra_info.solution, r.extra_info.tests, r.extra_info["index"])
        for r in CV.training_records(good, "_row").collect()
    ]
    row = [r._row for r in df.collect()]
    assert got == [
        ("7", '"NaN"', [], row[0]),
        ('["a",null]', "print(1)", ["x"], 4),
        ("p", "", ["{'a': 1}", "{'a': 2}"], row[3]),
        ('{"1":"one"}', "", [], row[4]),
    ]
    # the same through the job, with the rejects written
    from rewardframe.operators import jobs as J

    df.drop("_row").write.parquet(str(tmp_path / "in.parquet"))
    report = J.convert_job(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"), rejects_path=str(tmp_path / "rejects")).first()
    assert (report.total, report.rejected) == (4, 1)
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1

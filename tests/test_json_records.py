"""JSON files larger than a split, cut into records by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rewardframe.sources import readers as RD


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def some_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 1.5, -7, "", "}", '"', "\\", '\\"}', "é}", "a,b]", "{[,"])
    if kind in (1, 2, 3):
        return "".join(rng.choices('ab}{][,:"\\\n é', k=rng.randint(0, 30)))
    if kind == 4:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["data", "items", "k", "x}y", 'q"']): some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def expected(doc):
    if isinstance(doc, list):
        return doc
    if isinstance(doc, dict):
        for k in ["data", "items", "examples", "train", "test"]:
            if isinstance(doc.get(k), list):
                return doc[k] or [doc]
    return [doc]


def records(spark, path, **options):
    rows = RD.read_json_document(spark, str(path), **options)
    placed = rows.select(*RD.ORIGIN, F.to_json("v").alias("j")).orderBy(*RD.ORIGIN).collect()
    return [(r.src_file.rsplit("/", 1)[-1], json.loads(r.j)) for r in placed]


@pytest.mark.parametrize("split", [64, 700])
def test_files_cut_by_several_tasks(spark, tmp_path, small_splits, split):
    rng = random.Random(split)
    want = []
    for i in range(8):
        rows = [some_value(rng) for _ in range(rng.randint(0, 40))]
        doc = [
            rows,
            {"version": 2, "meta": {"data": [1, 2], "n": [3, {"items": []}]}, "items": rows, "more": [1, 2]},
            {"items": [1, {"a": 2}], "note": "x}, [", "data": rows, "test": [5]},
            {"a": some_value(rng), "b": rows},
            {"train": [], "test": rows, "pad": "y" * 300},
            [],
            {"data": [{"k": "z" * 2500}]},
            "only a } string" * 20,
        ][i % 8]
        text = json.dumps(doc, indent=rng.choice([None, None, 2]), ensure_ascii=i % 3 == 0)
        (tmp_path / f"f{i:02d}.json").write_text(text + rng.choice(["", "\n", "  \n"]), encoding="utf-8")
        want += [(f"f{i:02d}.json", r) for r in expected(doc)]
    assert records(spark, tmp_path) == want  # one row for each file
    small_splits(split)
    assert records(spark, tmp_path, whole_file=0) == want
    assert records(spark, tmp_path, whole_file=600) == want
    tasks = RD.read_json_document(spark, str(tmp_path / "f06.json"), whole_file=0).rdd.getNumPartitions()
    assert tasks > 2


def test_a_repeated_key_and_nested_lists(spark, tmp_path, small_splits):
    small_splits(16)
    (tmp_path / "a.json").write_text('{"data": [1, 2], "x": {"data": [7]}, "data" : [[3, 4], {"data": [5]}, 6]}')
    assert [r for _, r in records(spark, tmp_path, whole_file=0)] == [[3, 4], {"data": [5]}, 6]


@pytest.mark.parametrize(
    "text, what",
    [
        ('[{"a": 1}, {"b": 2}', "not closed"),
        ('{"data": [{"a": 1}, {"b": 2}]', "not closed"),
        ('[{"a": "x}]', "not closed"),
        ('[{"a": 1}] [{"b": 1}]', "more after"),
        ('[{"a": 1}, {"b": 2},, {"c": 3}]', "not a JSON document"),
        ('[{"a": 1}, {b: 2}, {"c": 3}]', "not a JSON document"),
    ],
)
def test_corrupt_files_are_named(spark, tmp_path, small_splits, text, what):
    small_splits(8)
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match=what) as e:
        records(spark, tmp_path, whole_file=0)
    assert "bad.json" in str(e.value)


def test_a_file_of_more_than_one_value_can_hold(spark, tmp_path):
    """140 MB, more than fits in one VARIANT, and one string too long to parse."""
    row = '{"k": [1, "' + "x" * 1000 + '"]}'
    n = 140_000
    with open(tmp_path / "large.json", "w") as f:
        f.write('{"version": 1, "data": [')
        f.write(",\n".join([row] * n))
        f.write("]}")
    rows = RD.read_json_document(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    assert rows.agg(F.count(F.lit(1)), F.sum(F.length(F.try_variant_get("v", "$.k[1]", "string")))).first()[:] == (n, 1000 * n)
    (tmp_path / "large.json").write_text('[{"a": 1}, {"b": "' + "x" * 20_000_001 + '"}]')
    with pytest.raises(Exception, match="large.json, record 1"):
        RD.read_json_document(spark, str(tmp_path), whole_file=1 << 20).select(F.to_json("v")).collect()


def test_a_record_beyond_the_limit_is_named(spark, tmp_path, small_splits):
    small_splits(100)
    (tmp_path / "wide.json").write_text(json.dumps([{"a": 1}, {"b": ["}" * 50] * 40}, {"c": 2}]))
    assert len(records(spark, tmp_path, whole_file=0)) == 3
    with pytest.raises(Exception, match="wide.json.*takes over 900 bytes"):
        records(spark, tmp_path, whole_file=0, limit=900)
    (tmp_path / "wide.json").write_text(json.dumps({"b": ["}" * 50] * 40}))
    with pytest.raises(Exception, match="wide.json.*one record of over 900 bytes"):
        records(spark, tmp_path, whole_file=0, limit=900)


def test_one_file_is_written_by_several_tasks(spark, tmp_path):
    """the rows of one array in one file do not pass one task."""
    from pyspark import TaskContext

    from rewardframe.sources import sinks as SK

    task = F.udf(lambda i: TaskContext.get().partitionId(), "int")
    # repartitioned by number, which is not coalesced
    df = spark.range(500).repartitionByRange(5, "id").sortWithinPartitions("id").select("id", F.lit('a"},\n').alias("x"))
    df = df.where("id < 90 or id > 220")  # a part may be empty
    for _ in range(2):  # the second one replaces the first
        SK.write_json_array(df.withColumn("task", task("id")), str(tmp_path / "one"), one_file=True)
    files = [f for f in (tmp_path / "one").iterdir() if f.name[0] not in "._"]
    rows = json.loads(files[0].read_text())
    assert len(files) == 1 and [r["id"] for r in rows] == [*range(90), *range(221, 500)] and {r["x"] for r in rows} == {'a"},\n'}
    assert len({r["task"] for r in rows}) > 2
    assert [f.name for f in tmp_path.iterdir()] == ["one"]
    SK.write_json_array(df.limit(0), str(tmp_path / "none"), one_file=True)
    assert [json.loads(f.read_text()) for f in (tmp_path / "none").iterdir() if f.name[0] not in "._"] == [[]]


def test_files_of_one_split_are_cut_in_one_pass(spark, tmp_path):
    """records go across splits only where a file has several; the other files are opened by neither pass."""
    for i in range(6):
        doc = [{"n": 10 * i + j} for j in range(9)] if i % 2 else {"data": [], "n": i, "pad": "}" * 90}
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    (tmp_path / "small.json").write_text('{"n": -1}')
    rows = RD.read_json_document(spark, str(tmp_path), whole_file=20)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted(r[0] for r in rows.select(F.try_variant_get("v", "$.n", "int")).collect())
    assert got == sorted([-1, 0, 2, 4, *(10 * i + j for i in (1, 3, 5) for j in range(9))])
    assert RD._small_documents(spark, str(tmp_path), 20).count() == 1


def test_the_files_of_documents_lie_in_few_folders(spark, sf):
    """a file for each list and each single document, in folders of 2,048 documents."""
    import os

    from rewardframe.plans.q_io import _documents_as_files

    out = _documents_as_files(spark, sf, "few").removeprefix("file:")
    folders = {d: [f for f in names if f.startswith("part-")] for d, _, names in os.walk(out)}
    ids = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    alone = {i for i in ids if i % 32 == 2}
    assert sum(map(len, folders.values())) == len(alone) + len({i // 128 for i in ids if i not in alone})
    assert sum(1 for names in folders.values() if names) == len({i // 2048 for i in ids})

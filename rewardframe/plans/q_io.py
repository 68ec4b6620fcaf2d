"""Round trips through files (sources and sinks) and streaming queries.

Inputs are written from the driver's tables into a fresh folder under the shared checkpoint
folder, then read back with the library's readers; the oracles compute the expected
surviving rows from the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardframe.operators import sampling as SM
from rewardframe.plans.registry import r6, register
from rewardframe.session import table
from rewardframe.sources import readers as RD
from rewardframe.sources import sinks as SK
from rewardframe.streaming import scoring as ST


def _jsonl_lines(spark, sf_dir):
    """documents -> JSON Lines text: every 7th line broken, every 11th blank, every 13th with a
    lone surrogate escape inside the prompt, the rest plain records."""
    d = table(spark, sf_dir, "documents")
    rec = F.to_json(F.struct(F.col("doc_id"), F.col("text").alias("prompt"), F.col("lang"), F.col("source")))
    with_sur = F.regexp_replace(rec, '"prompt":"', '"prompt":"\\\\ud800')
    line = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{bad json "), F.col("doc_id").cast("string")))
        .when(F.col("doc_id") % 11 == 0, F.lit(""))
        .when(F.col("doc_id") % 13 == 0, with_sur)
        .otherwise(rec)
    )
    out = SK.scratch_dir(spark, "jsonl")
    d.select(line.alias("value")).write.text(out)
    return out


_GOOD = "from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0"


@register(
    "read_lenient",
    f"select doc_id, text as prompt, lang {_GOOD}",
)
def read_lenient(spark, sf_dir):
    good, _ = RD.read_lenient(spark, _jsonl_lines(spark, sf_dir))
    typed = RD.variant_columns(good, {"doc_id": "bigint", "prompt": "string", "lang": "string"})
    return typed.select("doc_id", "prompt", "lang")


@register(
    "read_rejects",
    "select count(*) filter (where doc_id % 7 = 0) as n_bad_json, count(*) filter (where doc_id % 7 <> 0 and doc_id % 11 = 0) as n_blank from documents",
)
def read_rejects(spark, sf_dir):
    _, bad = RD.read_lenient(spark, _jsonl_lines(spark, sf_dir))
    return bad.agg(F.count_if(F.col("raw") != "").alias("n_bad_json"), F.count_if(F.col("raw") == "").alias("n_blank"))


@register(
    "convert_extra",
    f"select doc_id, 'doc_id,lang,source' as extra_keys, to_json(source)::varchar as extra_source {_GOOD}",
)
def convert_extra(spark, sf_dir):
    """Pass-through keys of VARIANT records (P6 X1): everything except the consumed keys."""
    good, _ = RD.read_lenient(spark, _jsonl_lines(spark, sf_dir))
    extra = RD.variant_extra("v", ["prompt", "solution", "tests", "problem", "code", "answer"])
    return good.select(
        F.try_variant_get("v", "$.doc_id", "bigint").alias("doc_id"), extra.alias("e")
    ).select("doc_id", F.array_join(F.array_sort(F.map_keys("e")), ",").alias("extra_keys"), F.col("e")["source"].alias("extra_source"))


def _documents_as_files(spark, sf_dir, name: str):
    """documents -> JSON files, named in order: one for each 128 of them, in turn a top-level array or
    an object with a record list; before it, of every 32 one by itself, as an object whose first
    record list is empty (which is one record). A folder holds the files of 2,048 documents; each is
    written by one task, a file for each row."""
    alone = F.col("doc_id") % 32 == 2
    grp = F.floor(F.col("doc_id") / 128)
    digits = F.lpad(grp.cast("string"), 9, "0")
    folder = F.lpad(F.floor(F.col("doc_id") / 2048).cast("string"), 9, "0")
    named = F.when(alone, F.concat(digits, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))).otherwise(F.concat(digits, F.lit("~")))
    d = table(spark, sf_dir, "documents").where(alone.isNotNull()).select(
        folder.alias("folder"), named.alias("name"), grp.alias("grp"), alone.alias("alone"), "doc_id", "text", "lang"
    )
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "text", "lang")))
    # one shuffle: the files of a folder are made where its rows are
    files = d.repartition("folder").groupBy("folder", "name", "grp", "alone").agg(rows.alias("rows"))
    as_list = F.when(F.col("grp") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.lit(1).alias("version"), F.col("rows").alias("data"))))
    one = F.transform("rows", lambda r: F.to_json(
        F.struct(F.array().cast("array<int>").alias("data"), F.array(r["doc_id"]).alias("items"), r["doc_id"].alias("doc_id"), r["text"].alias("text"), r["lang"].alias("lang"))
    ))
    values = files.select("folder", "name", F.when(F.col("alone"), F.array_join(one, "\n")).otherwise(as_list).alias("value"))
    out = SK.scratch_dir(spark, name)
    values.sortWithinPartitions("folder", "name").drop("name").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(out)
    return out


@register("json_document_records", "select doc_id, text, lang from documents")
def json_document_records(spark, sf_dir):
    """JSON files of every shape, read back (S3); those of over 64 KB are cut into records by the tasks
    that their splits make, the others are one row each."""
    got = RD.read_json_document(spark, _documents_as_files(spark, sf_dir, "json"), whole_file=1 << 16)
    return RD.variant_columns(got, {"doc_id": "bigint", "text": "string", "lang": "string"}).select("doc_id", "text", "lang")


@register(
    "json_one_file",
    "select doc_id, text, lang, cast(row_number() over (order by doc_id) - 1 as bigint) as position from documents",
)
def json_one_file(spark, sf_dir):
    """All documents as one JSON array in one file of many splits, read by as many tasks, with the
    positions of the records (S3 P7)."""
    out = SK.scratch_dir(spark, "json-one")
    ordered = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").orderBy("doc_id")
    SK.write_json_array(ordered, out, one_file=True)
    rows = RD.read_json_document(spark, out, whole_file=1 << 16)
    fields = {"doc_id": "bigint", "text": "string", "lang": "string"}
    return RD.variant_columns(SM.index_in_file_order(rows, "position"), fields).select(*fields, "position")


@register(
    "json_file_order",
    "select doc_id, text, cast(row_number() over (order by doc_id // 128, doc_id % 32 <> 2, doc_id) - 1 as bigint) as index from documents",
)
def json_file_order(spark, sf_dir):
    """Row index over many JSON files: the order of the files, then of the records in them."""
    rows = RD.read_any(spark, _documents_as_files(spark, sf_dir, "json-order"), "json")
    return RD.variant_columns(SM.index_in_file_order(rows), {"doc_id": "bigint", "text": "string"}).select("doc_id", "text", "index")


@register(
    "jsonl_file_order",
    f"select doc_id, text, cast(row_number() over (order by doc_id) - 1 as bigint) as index {_GOOD}",
)
def jsonl_file_order(spark, sf_dir):
    """Row index of the good lines over JSON Lines files of different sizes, in file order."""
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 7 == 0, "{bad").when(F.col("doc_id") % 11 == 0, "").otherwise(F.to_json(F.struct("doc_id", "text")))
    # folders of very different sizes, in the order of their names; dealt by range, so a folder has as
    # many files as tasks hold its rows
    name = F.lpad(F.floor(F.log2(F.col("doc_id") + 1)).cast("string"), 3, "0")
    out = SK.scratch_dir(spark, "jsonl-order")
    named = d.select(name.alias("part"), "doc_id", line.alias("value")).repartitionByRange("doc_id").sortWithinPartitions("part", "doc_id")
    named.drop("doc_id").write.partitionBy("part").text(out)
    rows = RD.read_any(spark, out, "jsonl")
    return RD.variant_columns(SM.index_in_file_order(rows), {"doc_id": "bigint", "text": "string"}).select("doc_id", "text", "index")


@register("read_strict", "select doc_id, text, lang from documents")
def read_strict(spark, sf_dir):
    """JSON Lines with a schema, read strictly."""
    out = SK.scratch_dir(spark, "strict")
    SK.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), out)
    return RD.read_strict(spark, out, "doc_id bigint, text string, lang string")


@register(
    "read_splits",
    "select doc_id, text, case when doc_id % 3 = 0 then 'test' else 'train' end as split from documents",
)
def read_splits(spark, sf_dir):
    """Named splits, one Parquet and read by suffix."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = SK.scratch_dir(spark, "splits")
    d.where("doc_id % 3 = 0").write.parquet(f"{base}/test.parquet")
    d.where("doc_id % 3 <> 0").write.parquet(f"{base}/train.parquet")
    return RD.read_splits(spark, {"test": f"{base}/test.parquet", "train": f"{base}/train.parquet"})


@register("missing_input_raises", "select 3 as n_raised, count(*) as n_documents, cast(sum(length(text)) as bigint) as chars from documents")
def missing_input_raises(spark, sf_dir):
    """Reading a missing neighbour of the documents raises for every format."""
    from pyspark.errors import AnalysisException

    raised = 0
    for kind in ("jsonl", "json", "parquet"):
        try:
            RD.read_any(spark, f"{sf_dir}/no-documents.{kind}").schema  # noqa: B018
        except AnalysisException:
            raised += 1
    d = RD.read_any(spark, f"{sf_dir}/documents.parquet")
    return d.agg(F.lit(raised).alias("n_raised"), F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@register(
    "prompt_text",
    """select doc_id, case cast(doc_id % 4 as int) when 0 then text when 1 then text when 2 then text
  else concat('[', cast(doc_id as varchar), ']') end as prompt from documents""",
)
def prompt_text(spark, sf_dir):
    """Prompts of VARIANT records as text: strings, objects with a text key, other values."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    as_json = (
        F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("  "), "text", F.lit("\n")).alias("p"))))
        .when(k == 1, F.to_json(F.struct(F.struct(F.lit(1).alias("id"), F.col("text").alias("content")).alias("p"))))
        .when(k == 2, F.to_json(F.struct(F.struct(F.col("lang").alias("question"), F.col("text").alias("text")).alias("p"))))
        .otherwise(F.to_json(F.struct(F.array("doc_id").alias("p"))))
    )
    v = F.try_variant_get(F.parse_json(as_json), "$.p", "variant")
    return d.select("doc_id", v.alias("v")).select("doc_id", RD.prompt_text("v").alias("prompt"))


@register("sink_round_trip", "select doc_id, n_chars, lang, text from documents")
def sink_round_trip(spark, sf_dir):
    """Parquet, JSON Lines and JSON array sinks, and the checked replace of an existing output
    (K1 K2 K3 K4 K5)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "text")
    base = SK.scratch_dir(spark, "sinks")
    SK.write_dataset(d.where(F.col("doc_id") < 0), f"{base}/out", "parquet")  # an existing, stale output
    SK.replace_path(d, f"{base}/out", "parquet")
    SK.write_dataset(spark.read.parquet(f"{base}/out"), f"{base}/jsonl", "jsonl")
    lines = spark.read.schema("doc_id bigint, n_chars bigint, lang string, text string").json(f"{base}/jsonl")
    SK.write_dataset(lines, f"{base}/arrays", "json")
    fields = {"doc_id": "bigint", "n_chars": "bigint", "lang": "string", "text": "string"}
    return RD.variant_columns(RD.read_json_document(spark, f"{base}/arrays"), fields).select(*fields)


@register("published_versions", "select doc_id, n_chars, text from documents")
def published_versions(spark, sf_dir):
    """An output that is published three times, each version made from the one before it, read back
    through its pointer (K5)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    path = SK.scratch_dir(spark, "published") + ".parquet"
    SK.publish(d.where("doc_id % 3 = 0"), path)
    for rest in (1, 2):
        SK.publish(RD.read_any(spark, path).unionByName(d.where(F.col("doc_id") % 3 == rest)), path)
    return RD.read_any(spark, path)


@register(
    "results_round_trip",
    """select d.lang as name, concat('org/', d.source) as model_name, round(avg(cast(l.quality as double)), 6) as pass_at_1
from documents d join labels l on l.doc_id = d.doc_id group by d.lang, d.source""",
)
def results_round_trip(spark, sf_dir):
    """Benchmark results written as one JSON array and read back (K7)."""
    from rewardframe.plans.fixtures import fixture

    out = SK.scratch_dir(spark, "results")
    SK.write_results(fixture(spark, sf_dir, "fx_bench").select("name", "model_name", "pass_at_1"), out)
    fields = {"name": "string", "model_name": "string", "pass_at_1": "double"}
    return RD.variant_columns(RD.read_json_document(spark, out), fields).select(*fields)


@register(
    "convert_rejects",
    """select case cast(doc_id % 5 as int) when 0 then 'decimal' when 1 then 'string' when 2 then 'array' else 'void' end as kind,
  count(*) as n from documents where doc_id % 5 < 4 group by 1""",
)
def convert_rejects(spark, sf_dir):
    """Lines that are JSON but no record are set aside with a reason, not converted."""
    from rewardframe.operators.convert import convertible, records_from_variant
    from rewardframe.session import materialize

    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    line = (
        F.when(k == 0, F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
        .when(k == 1, F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))
        .when(k == 2, F.to_json(F.array("text")))
        .when(k == 3, F.lit("null"))
        .otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    )
    out = SK.scratch_dir(spark, "rejects")
    d.select(line.alias("value")).write.text(out)
    good, rejects = convertible(RD.read_any(spark, out, "jsonl"))
    prompts = materialize(records_from_variant(good, "src_pos").select("prompt")).where("prompt = ''")
    kinds = rejects.select(F.regexp_extract("reason", "([a-z]+)$", 1).alias("kind")).unionByName(prompts.select(F.lit("blank record").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "convert_typed_aliases",
    """
with t as (select *, doc_id % 6 as k, cast(doc_id as varchar) as d from documents)
select doc_id,
  case when k = 5 then 'rejected' else 'converted' end as status,
  case k when 0 then text when 1 then d when 2 then concat('["', d, '","', lang, '"]') when 3 then concat('{"content":', to_json(text), ',"n":', d, '}')
    when 4 then text end as prompt,
  case k when 0 then concat('x = ', d) when 1 then concat(d, '.5') when 2 then concat('{"code":"', lang, '"}') when 3 then 'true' when 4 then '' end as solution,
  case k when 0 then concat('assert ', d, '|b') when 1 then 'a|c' when 2 then concat('t', d) when 3 then d when 4 then '' end as tests,
  case when k = 5 then 'no text: prompt is binary' end as reason
from t
""",
)
def convert_typed_aliases(spark, sf_dir):
    """A typed table whose alias columns are strings, numbers, arrays, structs and binary: each value
    is chosen by presence and keeps its kind; binary data that is no text is rejected (P1 P5 E4)."""
    from rewardframe.operators import convert as CV

    d = table(spark, sf_dir, "documents")
    i, k = F.col("doc_id"), F.col("doc_id") % 6
    sid = i.cast("string")
    typed = d.select(
        "doc_id",
        F.when(k == 0, F.col("text")).when(k == 1, F.lit(" \t")).alias("prompt"),
        F.when(k == 1, i).alias("problem"),
        F.when(k == 2, F.array(sid, F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("description"),
        F.when(k == 3, F.struct(F.col("text").alias("content"), i.alias("n"))).alias("question"),
        F.when(k == 4, F.col("text").cast("binary")).when(k == 5, F.unhex(F.lit("FFFE00"))).alias("input"),
        F.when(k == 0, F.concat(F.lit("x = "), sid)).otherwise(F.lit("")).alias("solution"),
        F.when(k == 1, i.cast("decimal(20,1)") + F.lit("0.5").cast("decimal(2,1)")).alias("code"),
        F.when(k == 2, F.create_map(F.lit("code"), F.col("lang"))).alias("answer"),
        F.when(k == 3, F.lit(True)).alias("output"),
        F.when(k == 0, F.array(F.concat(F.lit("assert "), sid), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tests"),
        F.when(k == 1, F.lit('["a", "c"]')).alias("test_cases"),
        F.when(k == 2, F.struct(F.array(F.concat(F.lit("t"), sid)).alias("tests"))).alias("test"),
        F.when(k == 3, i).alias("checks"),
    )
    out = SK.scratch_dir(spark, "typed")
    typed.write.parquet(out)
    rows, rejects = CV.convertible_rows(RD.read_any(spark, out, "parquet"), ["doc_id"])
    records = CV.training_records(rows, "doc_id")
    return records.select(
        F.col("extra_info.index").alias("doc_id"), F.lit("converted").alias("status"), "prompt", F.col("extra_info.solution").alias("solution"),
        F.array_join("reward_model.ground_truth", "|").alias("tests"), F.lit(None).cast("string").alias("reason"),
    ).unionByName(rejects.select("doc_id", F.lit("rejected").alias("status"), "reason"), allowMissingColumns=True)


# ----------------------------------------------------------------------------- streaming

_STREAM_FLAGS = """
with f as (
  select event_id as sample_id, event_type <> 'error' as has_code,
    event_type <> 'error' and event_id % 7 <> 3 as syntax_valid,
    event_type <> 'error' and event_id % 7 <> 3 and event_id % 11 <> 5 as compile_valid,
    case when event_type = 'view' then 2 when event_type = 'click' then 1 else 0 end as p,
    length(props) as code_length
  from events),
k as (select *, case when not has_code then 'blank' when not syntax_valid then 'syntax' when not compile_valid then 'compile' else 'run' end as cls from f)
"""


@register(
    "stream_score",
    _STREAM_FLAGS
    + """
select sample_id,
  round(case cls when 'blank' then -1.5 when 'syntax' then -1.0 when 'compile' then -0.5
    else 0.0 + (case when p = 0 then -0.2 else 0.0 end) + (case when p > 0 then (p / 2.0) * 2.0 else 0.0 end)
      + (case when p = 2 then 1.0 else 0.0 end) end::double, 6) as reward,
  case when cls = 'run' then p::double else 0.0::double end as passed,
  case when cls = 'run' and p = 2 then 1.0::double else 0.0::double end as acc
from k
""",
)
def stream_score(spark, sf_dir):
    """Stateless streaming scoring over the events file, processed with availableNow (ST1)."""
    events = ST.stream_from_files(spark, f"{sf_dir}/events.parquet")
    scored = ST.score_stream(ST.event_flags(events), keep=("sample_id",))
    out, ckpt = ST.scratch_for(spark, "stream-score")
    ST.run_available(scored, out, ckpt, "append")
    res = spark.read.parquet(out)
    return res.select("sample_id", r6("reward").alias("reward"), "passed", "acc")


@register(
    "stream_stats",
    _STREAM_FLAGS
    + """
select count(*) as total_samples, count(*) filter (where cls = 'blank') as empty_samples,
  count(*) filter (where cls = 'syntax') as syntax_errors, count(*) filter (where cls = 'compile') as compile_errors,
  cast(0 as bigint) as runtime_errors, count(*) filter (where cls = 'run' and p = 2) as full_pass,
  round(count(*) filter (where cls = 'run' and p = 2) / count(*)::double, 6) as full_pass_rate
from k
""",
)
def stream_stats(spark, sf_dir):
    """Running manager totals as a streaming global aggregation, complete mode (ST2); one file
    per micro-batch, so with more files the totals are carried in checkpointed state."""
    events = ST.stream_from_files(spark, f"{sf_dir}/events.parquet", max_files_per_trigger=1)
    stats = ST.stats_stream(ST.score_stream(ST.event_flags(events)))
    out, ckpt = ST.scratch_for(spark, "stream-stats")
    ST.run_available(stats, out, ckpt, "complete")
    res = ST.latest_result(spark, out)
    return res.select("total_samples", "empty_samples", "syntax_errors", "compile_errors", "runtime_errors", "full_pass",
                      r6("full_pass_rate").alias("full_pass_rate"))


@register(
    "stream_stats_batches",
    _STREAM_FLAGS
    + """
select count(*) as total_samples, count(*) filter (where cls = 'blank') as empty_samples,
  count(*) filter (where cls = 'syntax') as syntax_errors, count(*) filter (where cls = 'compile') as compile_errors,
  cast(0 as bigint) as runtime_errors, count(*) filter (where cls = 'run' and p = 2) as full_pass,
  round(count(*) filter (where cls = 'run' and p = 2) / count(*)::double, 6) as full_pass_rate
from k
""",
)
def stream_stats_batches(spark, sf_dir):
    """The totals over three files, a batch for each, with a restart from the checkpoint after the first:
    state is carried from batch to batch and over the restart (ST2)."""
    events = table(spark, sf_dir, "events")
    base = SK.scratch_dir(spark, "stats-batches")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for stage, condition in enumerate((part == 0, part > 0)):
        events.where(condition).repartition(1 + stage, part).sortWithinPartitions(part).write.mode("append").parquet(f"{base}/in")
        stream = ST.stream_from_files(spark, f"{base}/in", max_files_per_trigger=1)
        ST.run_available(ST.stats_stream(ST.score_stream(ST.event_flags(stream))), f"{base}/out", f"{base}/checkpoint", "complete")
    res = ST.latest_result(spark, f"{base}/out")
    return res.select("total_samples", "empty_samples", "syntax_errors", "compile_errors", "runtime_errors", "full_pass",
                      r6("full_pass_rate").alias("full_pass_rate"))


def _mixed_jsonl(spark, sf_dir):
    """documents -> JSON Lines whose records use different alias keys and value shapes."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    sid = i.cast("string")
    head = F.col("text")
    k = i % 4
    line = (
        F.when(k == 0, F.to_json(F.struct(i.alias("doc_id"), head.alias("prompt"), F.concat(F.lit("x = "), sid).alias("solution"),
                                          F.array(F.concat(F.lit("assert x == "), sid)).alias("tests"), F.col("lang"))))
        .when(k == 1, F.to_json(F.struct(i.alias("doc_id"), head.alias("question"), F.concat(F.lit("y = "), sid).alias("code"),
                                         F.lit('["assert 1", " "]').alias("test_cases"), F.col("lang"))))
        .when(k == 2, F.to_json(F.struct(i.alias("doc_id"), F.lit("   ").alias("prompt"), head.alias("problem"), F.lit("").alias("answer"),
                                         F.concat(F.lit("r"), sid).alias("response"), F.array().cast("array<string>").alias("tests"),
                                         F.array(F.lit("c")).alias("checks"), F.col("lang"))))
        .otherwise(F.to_json(F.struct(i.alias("doc_id"), head.alias("description"), F.col("lang"), F.lit(7).alias("index"),
                                      F.lit("test").alias("split"))))
    )
    out = SK.scratch_dir(spark, "mixed")
    d.select(line.alias("value")).write.text(out)
    return out


@register(
    "convert_jsonl_records",
    """
select doc_id, text as prompt,
  case doc_id % 4 when 0 then concat('x = ', cast(doc_id as varchar)) when 1 then concat('y = ', cast(doc_id as varchar))
       when 2 then concat('r', cast(doc_id as varchar)) else '' end as solution,
  case doc_id % 4 when 0 then concat('assert x == ', cast(doc_id as varchar)) when 1 then 'assert 1' when 2 then 'c' else '' end as tests,
  case doc_id % 4 when 0 then 'doc_id,lang' when 1 then 'doc_id,lang,question,test_cases' when 2 then 'checks,doc_id,lang,response' else 'description,doc_id,lang' end as extra_keys,
  case when doc_id % 4 = 3 then 'test' else 'train' end as split,
  case when doc_id % 4 = 3 then cast(7 as bigint) end as source_index
from documents
""",
)
def convert_jsonl_records(spark, sf_dir):
    """Lenient JSON Lines -> VARIANT -> alias resolution -> training records."""
    from rewardframe.operators.convert import records_from_variant

    good, _ = RD.read_lenient(spark, _mixed_jsonl(spark, sf_dir))
    rec = records_from_variant(good, "src_pos")
    return rec.select(
        F.col("extra_info.extra")["doc_id"].cast("bigint").alias("doc_id"),
        "prompt",
        F.col("extra_info.solution").alias("solution"),
        F.array_join("reward_model.ground_truth", "|").alias("tests"),
        F.array_join(F.array_sort(F.map_keys("extra_info.extra")), ",").alias("extra_keys"),
        F.col("extra_info.split").alias("split"),
        F.when(F.col("extra_info.split") == "test", F.col("extra_info.index")).alias("source_index"),
    )

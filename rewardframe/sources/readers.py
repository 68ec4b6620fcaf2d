"""Readers: lenient / strict JSONL, whole-JSON files, Parquet, dispatch by suffix, named splits.

Rows of unknown shape are kept as VARIANT (``v``); typed columns come from
``try_variant_get`` at use. Every reader is a Spark file scan: nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.sources.json_records import LIMIT, pieces_of, read_large_documents
from rewardframe.sources.sinks import current_version

#: Bytes of a JSON file that is read as one row.
WHOLE_FILE = 64 << 20

# Fixed values that must equal the reference's for equal results.
# Keys of a top-level JSON object that may hold the list of records, in order.
RECORD_LIST_KEYS = ["data", "items", "examples", "train", "test"]

# Unpaired UTF-16 surrogate escapes in raw JSON text (a valid high+low pair is kept). The
# leading group keeps an even run of backslashes so an escaped backslash is not mistaken
# for the start of an escape.
_SURROGATE = (
    r"(?<!\\)((?:\\\\)*)(?:(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})"
    r"|\\u[dD][89a-fA-F][0-9a-fA-F]{2})"
)


def scrub_surrogates(raw: str | Column) -> Column:
    """Drop lone surrogate escapes from raw JSON text before parsing (after parsing Spark would
    have turned them into '?'). Only texts with a ``\\u`` escape are searched."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.when(F.contains(c, F.lit("\\u")), F.regexp_replace(c, _SURROGATE, "$1$2")).otherwise(c)


# Where a row comes from, in the order of the input: file, split of the file, place in the split.
ORIGIN = ["src_file", "src_block", "src_pos"]


def _origin(pos: Column | None = None) -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        (F.monotonically_increasing_id() if pos is None else pos).alias("src_pos"),
    ]


def read_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines where bad and blank lines are set aside instead of failing the job.

    Returns (good rows ``src_file, src_block, src_pos, v VARIANT``, rejects with ``raw`` instead of
    ``v``). The source columns order the rows as the files and lines are (see
    ``sampling.index_in_file_order`` for positions)."""
    lines = spark.read.text(path).select(*_origin(), F.col("value").alias("raw"))
    lines = lines.withColumn("v", F.try_parse_json(scrub_surrogates("raw")))
    good = lines.where(F.col("v").isNotNull()).select(*ORIGIN, "v")
    bad = lines.where(F.col("v").isNull()).select(*ORIGIN, "raw")
    return good, bad


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a schema; any malformed line fails the job, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, whole_file: int = WHOLE_FILE, limit: int = LIMIT) -> DataFrame:
    """Whole-JSON files (S3): a list gives its elements; an object gives the first list among the
    record keys, or the object itself if there is none or it is empty. One row per record: the
    source columns and ``v VARIANT``. A file that is no JSON fails the job and is named.

    A file of at most ``whole_file`` bytes is one row and parsed at once; larger ones are cut into
    records by all the tasks that their splits make (see ``json_records``). A record of over ``limit``
    bytes fails the job and is named; so is one that Spark cannot parse, as it is no JSON or holds a string
    of over 20,000,000 characters.
    """
    pieces = pieces_of(spark, path, whole_file)
    if pieces.select("size").isEmpty():
        return _small_documents(spark, path)
    cut = read_large_documents(pieces, RECORD_LIST_KEYS, limit)
    v = F.try_parse_json(scrub_surrogates("raw"))
    place = [F.lit(", record "), F.col("src_pos").cast("string"), F.lit(" of the split at byte "), F.col("src_block").cast("string")]
    corrupt = F.raise_error(F.concat(F.lit("not a JSON document: "), F.col("src_file"), *place)).cast("variant")
    records = cut.select(*ORIGIN, v.alias("v")).select(*ORIGIN, F.when(F.col("v").isNull(), corrupt).otherwise(F.col("v")).alias("v"))
    return records.unionByName(_small_documents(spark, path, whole_file))


def _small_documents(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """Files (of at most ``up_to`` bytes; the others are not opened) of one row each."""
    files = spark.read.text(path, wholetext=True)
    files = files if up_to is None else files.where(F.col("_metadata.file_size") <= up_to)
    files = files.select(*_origin(F.lit(0).cast("bigint")), F.col("value").alias("raw"))
    parsed = files.withColumn("doc", F.try_parse_json(scrub_surrogates("raw")))
    corrupt = F.raise_error(F.concat(F.lit("not a JSON document: "), F.col("src_file")))
    as_list = F.try_variant_get("doc", "$", "array<variant>")
    first_list = F.coalesce(*[F.try_variant_get("doc", f"$.{k}", "array<variant>") for k in RECORD_LIST_KEYS])
    one = F.array(F.col("doc"))
    records = (
        F.when(F.col("doc").isNull(), corrupt.cast("array<variant>"))
        .when(as_list.isNotNull(), as_list)
        .when(F.size(first_list) > 0, first_list)
        .otherwise(one)
    )
    staged = parsed.select("src_file", "src_block", records.alias("records"))
    return staged.select("src_file", "src_block", F.posexplode("records").alias("src_pos", "v")).withColumn(
        "src_pos", F.col("src_pos").cast("bigint")
    )


def read_any(spark: SparkSession, path: str, fmt: str | None = None, origin: bool = False) -> DataFrame:
    """Dispatch by format or suffix: ``.jsonl`` lenient lines, ``.json`` documents, ``.parquet``.
    Missing paths raise Spark's PATH_NOT_FOUND (S7). ``origin`` adds the source columns to Parquet
    rows, which the other formats always have. Of a path with published versions the current one is read."""
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    path = current_version(spark, path)
    if kind == "jsonl":
        return read_lenient(spark, path)[0]
    if kind == "json":
        return read_json_document(spark, path)
    if kind == "parquet":
        rows = spark.read.parquet(path)
        return rows.select("*", *_origin(F.col("_metadata.row_index"))) if origin else rows
    raise ValueError(f"unsupported input format: {kind!r}")


def read_splits(spark: SparkSession, paths: Mapping[str, str], fmt: str | None = None) -> DataFrame:
    """Named splits from local snapshots: one DataFrame with a ``split`` column."""
    frames = [read_any(spark, p, fmt).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def variant_columns(df: DataFrame, fields: Mapping[str, str], v: str = "v") -> DataFrame:
    """Typed columns from the VARIANT record: ``{"name": "type"}``; absent keys give null."""
    return df.select("*", *[F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in fields.items()])


def variant_extra(v: str | Column, exclude: list[str]) -> Column:
    """Other top-level keys of a record as ``map<string, string>`` of JSON text."""
    c = F.col(v) if isinstance(v, str) else v
    m = F.try_variant_get(c, "$", "map<string,variant>")
    kept = F.map_filter(m, lambda k, _: ~k.isin(*exclude))
    return F.transform_values(kept, lambda _, x: F.to_json(x))


def prompt_text(v: str | Column) -> Column:
    """Prompt of a VARIANT record as text (P4): a string stripped; an object's first present key
    among ``PROMPT_TEXT_KEYS`` as text, stripped; anything else as its JSON text."""
    from rewardframe.functions.text import PROMPT_TEXT_KEYS, py_strip

    c = F.col(v) if isinstance(v, str) else v
    kind = F.schema_of_variant(c)
    obj = F.try_variant_get(c, "$", "map<string,variant>")
    chosen = F.coalesce(*[F.when(F.map_contains_key(obj, k), obj.getItem(k)) for k in PROMPT_TEXT_KEYS])
    chosen_text = F.when(F.schema_of_variant(chosen) == "STRING", F.try_variant_get(chosen, "$", "string")).otherwise(F.to_json(chosen))
    return (
        F.when(kind == "STRING", py_strip(F.try_variant_get(c, "$", "string")))
        .when(kind.startswith("OBJECT") & chosen.isNotNull(), py_strip(chosen_text))
        .otherwise(F.to_json(c))
    )

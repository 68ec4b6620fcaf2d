"""Seeded order, exact rank cut-offs, exact splits, SFT filters and funnel, dense row index.

The seeded order is that of md5(seed:id); rows with one id are ordered by a hash of the whole row,
so that an exact number of them can be taken. The row of rank N is found once, from counts by a
prefix of the key that grows until the prefix holds few rows, and is then a constant of every
filter that uses it: no sort of the data, no ``orderBy().limit()`` through one task, and several
outputs share one search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardframe.functions.text import col_, is_blank
from rewardframe.session import materialize

DEFAULT_SEED = 42
PREFIX_HEX = 4  # hex digits by which a prefix grows: at most 65,536 counts a step
BOUNDARY_ROWS = 100_000  # rows of a prefix that are ranked in one task


def seeded_key(id_col: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Repeatable shuffle key: md5 of ``seed:id`` (independent of partitioning; same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(id_col).cast("string")))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    key = F.coalesce(seeded_key(id_col, seed), F.lit(""))  # rows without an id come first
    return df.withColumns({"_key": key, "_row": F.xxhash64(*df.columns)})


@dataclass(frozen=True)
class Cut:
    """The row of a rank in the seeded order (its key and row hash), how many of the rows that
    equal it are within the rank, and how many there are. ``None`` as key: the rank is 0."""

    key: str | None
    row: int = 0
    within: int = 0
    equal: int = 0

    def split(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows up to the rank, and the others. Rows equal to the cut are interchangeable; only
        where some of them are within and some not, a number of them is taken."""
        if self.key is None:
            return keyed.where(F.lit(False)), keyed
        below = (F.col("_key") < self.key) | ((F.col("_key") == self.key) & (F.col("_row") < self.row))
        equal = (F.col("_key") == self.key) & (F.col("_row") == self.row)
        if self.within == self.equal:
            return keyed.where(below | equal), keyed.where(~(below | equal))
        head, tail = _take_any(keyed.where(equal), self.within)
        return keyed.where(below).unionByName(head), keyed.where(~(below | equal)).unionByName(tail)


def _take_any(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Any ``n`` of the rows, and the others. The rows are written and stay where they are: whole partitions
    are taken, and of one its first rows; only the partitions' counts reach the driver."""
    kept = materialize(rows)
    placed = kept.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    part, left = -1, n
    for p, count in sorted(map(tuple, placed.groupBy("_part").count().collect())):
        if left < count:
            part = p
            break
        left -= count
    else:
        return kept, kept.where(F.lit(False))
    taken = (F.col("_part") < part) | ((F.col("_part") == part) & (F.col("_at") < left))
    return placed.where(taken).drop("_part", "_at"), placed.where(~taken).drop("_part", "_at")


def find_cut(keyed: DataFrame, n: int | None = None, ratio: float | None = None) -> Cut | None:
    """Cut at rank ``n``, or at floor(rows * ratio); None if the rank is beyond the data. The search goes on
    by prefixes of the key, and where that is used up (one id, or no id, has very many rows) by
    prefixes of the row hash, until a prefix holds at most BOUNDARY_ROWS rows or equal ones only. Only
    counts by prefix (at most 65,536 a step) and the cut itself reach the driver."""
    # the row hash in the order of its values, behind the key; no key comes first
    sign = F.lit(-(1 << 63)).cast("bigint")
    digits = F.concat(F.rpad("_key", 32, " "), F.lpad(F.hex(F.col("_row").bitwiseXOR(sign)), 16, "0"))
    prefix, rows = "", keyed.select("_key", "_row", digits.alias("_digits"))
    while True:
        step = F.substring("_digits", len(prefix) + 1, PREFIX_HEX)
        counts = sorted(map(tuple, rows.groupBy(step).count().collect()))
        if ratio is not None:
            n, ratio = int(sum(c for _, c in counts) * ratio), None
        if n <= 0:
            return Cut(None)
        for part, count in counts:
            if n <= count:
                break
            n -= count
        else:
            return None
        prefix += part
        rows = rows.where(F.col("_digits").startswith(prefix))
        if count <= BOUNDARY_ROWS or len(prefix) >= 48:
            break
    order = Window.orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tallied = rows.groupBy("_key", "_row").count().withColumn("upto", F.sum("count").over(order))
    at = tallied.where(F.col("upto") >= n).orderBy("_key", "_row").first()
    return Cut(at["_key"], at["_row"], n - (at["upto"] - at["count"]), at["count"])


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_key", "_row")


def in_seeded_order(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """The rows in seeded order: range-partitioned and sorted by the seeded key, so files written
    from it, read in name order, hold the shuffled rows (L3)."""
    return _plain(_ordered(_keyed(df, id_col, seed)))


def _ordered(keyed: DataFrame) -> DataFrame:
    return keyed.repartitionByRange("_key", "_row").sortWithinPartitions("_key", "_row")


def first_n_by_key(df: DataFrame, n: int, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """The ``n`` rows first in the seeded order (exact), without funnelling them through one task."""
    keyed = _keyed(df, id_col, seed)
    cut = find_cut(keyed, n)
    return _plain(keyed if cut is None else cut.split(keyed)[0])


def split_exact(
    df: DataFrame, id_col: str, train_ratio: float = 0.95, seed: int = DEFAULT_SEED, ordered: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Exact ``int(total * ratio)`` rows to train, the rest to validation, by seeded order (also
    with repeated ids); with ``ordered`` both come in that order. One search serves both."""
    if not 0.0 <= train_ratio <= 1.0:
        raise ValueError("train_ratio must be within [0, 1]")
    keyed = _keyed(df, id_col, seed)
    cut = find_cut(keyed, ratio=train_ratio)
    parts = cut.split(keyed) if cut else (keyed, keyed.where(F.lit(False)))
    train, val = (_plain(_ordered(p) if ordered else p) for p in parts)
    return train, val


# ------------------------------------------------------------------ SFT filters

def sft_reason(
    instruction: str | Column,
    output: str | Column,
    max_total_chars: int | None = 3000,
    min_output_chars: int | None = None,
    single_counter: bool = False,
) -> Column:
    """First failing rule of a row: ``empty`` -> ``too_long`` -> ``too_short`` -> ``accepted``.

    ``single_counter=True`` reports every rejection as ``skipped`` (one counter, as source A does).
    Boundaries are kept: total == max and output == min pass.
    """
    i, o = col_(instruction), col_(output)
    r = F.when(is_blank(i) | is_blank(o), F.lit("empty"))
    if max_total_chars is not None:
        r = r.when(F.length(i) + F.length(o) > max_total_chars, F.lit("too_long"))
    if min_output_chars is not None:
        r = r.when(F.length(o) < min_output_chars, F.lit("too_short"))
    r = r.otherwise(F.lit("accepted"))
    if single_counter:
        r = F.when(r == "accepted", r).otherwise(F.lit("skipped"))
    return r


def sample_accepted(
    df: DataFrame, reason_col: str, id_col: str, max_samples: int | None = None, seed: int = DEFAULT_SEED, ordered: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Seeded scan that stops at the ``max_samples``-th accepted row (none: no limit).

    Returns (accepted rows up to the stop, with ``ordered`` in seeded order; funnel counts by
    reason over every row scanned). One search serves both.
    """
    scanned = keyed = _keyed(df, id_col, seed)
    ok = F.col(reason_col) == "accepted"
    accepted = keyed.where(ok)
    if max_samples:
        cut = find_cut(accepted, max_samples)
        if cut is not None:
            accepted = cut.split(accepted)[0]
            refused = (F.col("_key") < cut.key) | ((F.col("_key") == cut.key) & (F.col("_row") < cut.row))
            scanned = accepted.unionByName(keyed.where(~ok & refused))
    funnel = scanned.groupBy(reason_col).agg(F.count(F.lit(1)).alias("n"))
    return _plain(_ordered(accepted) if ordered else accepted), funnel


# ------------------------------------------------------------------ dense row index

def dense_index(df: DataFrame, order_col: str, out: str = "index", n_parts: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` order (unique values), exact.

    The rows are range-partitioned once by the key and written; the partitions' counts give their
    offsets (one row per partition), and a row's place in its partition comes from a window over
    the partition. No single-partition window over the data."""
    parts = n_parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(df.repartitionByRange(parts, order_col).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_part", (F.sum("_c").over(before) - F.col("_c")).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order_col)) - 1
    return (
        ranged.withColumn("_n", place)
        .join(offsets, "_part")
        .withColumn(out, (F.col("_off") + F.col("_n")).cast("bigint"))
        .drop("_part", "_off", "_n")
    )


def index_in_file_order(rows: DataFrame, out: str = "index") -> DataFrame:
    """0-based position of each row of ``readers`` output in the order of the files, their splits
    and the rows in them; the source columns go. The rows are written once (so each is parsed
    once). Their places alone are numbered within their split and meet the rows by the place, so a task
    holds no whole split; a split's offset is the sum of the splits before it, from one count per split."""
    rows = materialize(rows)
    split = ["src_file", "src_block"]
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_c"))
    # one row per split of the input
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*split, (F.sum("_c").over(before) - F.col("_c")).alias("_off"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("src_pos")) - 1
    numbered = rows.select(*split, "src_pos").withColumn("_n", place).join(offsets, split)
    index = numbered.select(*split, "src_pos", (F.col("_off") + F.col("_n")).cast("bigint").alias(out))
    return rows.join(index, [*split, "src_pos"]).drop(*split, "src_pos")


def with_position_id(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Id fallback: a missing id becomes the row position as text (P25)."""
    indexed = dense_index(df, order_col, "_pos")
    return indexed.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.col("_pos").cast("string"))).drop("_pos")

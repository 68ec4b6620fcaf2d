"""Dataset profiles: token-length describe, overview, head preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.functions.text import preview


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation, exact), max.

    ``percentile`` keeps one counter per distinct value (token counts are small integers), so
    its state grows with the number of distinct lengths, not with rows. ``df.summary()`` is not
    used: its quartiles are approximate and not interpolated.
    """
    c = F.col(col)
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
        q.alias("_q"), F.max(c).cast("double").alias("max"),
    ).select("count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


#: Rows that are sorted at once, and the accuracy of the summaries by which they are found.
SORTED_ROWS, ACCURACY = 10_000, 4_000


def ranked_values(df: DataFrame, col: str, ranks: list[int]) -> list:
    """The values of the given 0-based ranks among the non-null values of any orderable column, exactly.

    Each round takes a bounded summary (``percentile_approx``) of the rows that each rank can still be in,
    and counts how many lie below, at and between the two values that it gives around the rank. That
    answers the rank or leaves the rows strictly between, about 1 in ACCURACY / 4; so neither state nor
    rounds grow with the number of distinct values, and ties cost nothing."""
    c = F.col(col)
    low, high, left = ([None] * len(ranks) for _ in range(3))
    rows = df.select(c.alias("x")).where(F.col("x").isNotNull())
    total, answers, at = rows.count(), {}, list(ranks)
    left = [total] * len(ranks)
    x = F.col("x")

    def inside(i: int):
        cond = F.lit(True)
        cond = cond & (x > low[i]) if low[i] is not None else cond
        return cond & (x < high[i]) if high[i] is not None else cond

    spread = [4.0 / ACCURACY] * len(ranks)
    while len(answers) < len(ranks):
        open_ = [i for i in range(len(ranks)) if i not in answers]
        small = [i for i in open_ if left[i] <= SORTED_ROWS]
        if small:
            kept = rows.agg(*(F.sort_array(F.collect_list(F.when(inside(i), x))).alias(f"r{i}") for i in small)).first()
            answers |= {i: kept[f"r{i}"][at[i]] for i in small}
            continue
        ends = {}
        for i in open_:
            p = (at[i] + 0.5) / left[i]
            ends[i] = [max(0.0, p - spread[i]), min(1.0, p + spread[i])]
        found = rows.agg(*(F.percentile_approx(F.when(inside(i), x), ends[i], ACCURACY).alias(f"r{i}") for i in open_)).first()
        counts = rows.agg(
            *(F.count_if(inside(i) & cond).alias(f"{name}{i}") for i in open_ for name, cond in (
                ("below", x < found[f"r{i}"][0]), ("first", x == found[f"r{i}"][0]), ("upto", x < found[f"r{i}"][1]), ("last", x == found[f"r{i}"][1])))
        ).first()
        for i in open_:
            a, b = found[f"r{i}"]
            below, first, upto, last = (counts[f"{n}{i}"] for n in ("below", "first", "upto", "last"))
            if below <= at[i] < below + first:
                answers[i] = a
            elif upto <= at[i] < upto + last:
                answers[i] = b
            elif below + first <= at[i] < upto:
                low[i], high[i], at[i], left[i] = a, b, at[i] - below - first, upto - below - first
            elif at[i] < below:  # outside the two values: the summary was less exact than asked
                high[i], left[i], spread[i] = a, below, 2 * spread[i]
            else:
                low[i], at[i], left[i], spread[i] = b, at[i] - upto - last, left[i] - upto - last, 2 * spread[i]
    return [answers[i] for i in range(len(ranks))]


def exact_quantiles(df: DataFrame, col: str, probabilities: list[float]) -> list[float | None]:
    """Quantiles of a numeric column with linear interpolation; None for each if it has no values."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    ranks = sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))})
    value = dict(zip(ranks, (float(v) for v in ranked_values(df, col, ranks))))
    out = []
    for p in places:
        a, b = value[int(p)], value[min(int(p) + 1, n - 1)]
        out.append(a if a == b else a + (b - a) * (p - int(p)))
    return out


def describe_values(df: DataFrame, col: str) -> DataFrame:
    """``describe`` for a column of any number of distinct values: the same row, with quartiles found by
    rank search (A7)."""
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    c = F.col(col)
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
        *(F.lit(q).cast("double").alias(name) for q, name in zip(quartiles, ("p25", "p50", "p75"))), F.max(c).cast("double").alias("max"),
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: row count, column count, column names (names known at plan time)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.lit(",".join(df.columns)).alias("columns")
    )


def head_preview(df: DataFrame, order_col: str, text_col: str, n: int = 5, width: int = 300) -> DataFrame:
    """First ``n`` rows by ``order_col`` with the text cut to ``width`` characters plus ``...``.
    A head report: the limit is the feature (planned as a top-k, not a sort of everything)."""
    return df.orderBy(order_col).limit(n).select(
        *[c for c in df.columns if c != text_col], preview(text_col, width).alias(f"{text_col}_preview")
    )

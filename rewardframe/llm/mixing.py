"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source gets a target size in proportion to its weight. A source whose target would exceed
``max_epochs`` times its size is clamped there and the excess is shared again among the rest in
proportion to their weights, until no source is above its cap. A source's documents are then
repeated ``floor(target / size)`` times, and the fractional rest is met by taking each document
once more whose seeded hash is not above the source's cut. The cut is exact: sizes are summed by
ranges of the hash, at each round for the range that the quota falls into, until it holds few
documents, which are ordered; so a source that holds most rows has no large window.

Defined results: a null text has size 0; a null source is a source of its own; an empty table
gives an empty mix; a source of size 0 or of weight 0 or less has target 0. Documents equal in id
and text share one draw. The taken size is within half of the largest document of the target.
Columns of the input keep their values. ``mix_sources`` adds ``mix_size, mix_source_size, mix_target,
mix_copies``, which replace columns of these names; ``repeated`` gives back the input's columns only,
whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardframe.llm.common import words_in, written
from rewardframe.operators.sampling import dense_index

MAX_EPOCHS = 3.0
SEED = 20240607
#: Documents that are ordered at once, and bits of the draw by which a range is divided.
BUCKET_DOCS, STEP_BITS = 1024, 10
DRAW_BITS = 62
MASK = (1 << DRAW_BITS) - 1


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Seeded draw of a document: 62 uniform bits."""
    return F.xxhash64(doc_id, text, F.lit(seed)).bitwiseAND(F.lit(MASK))


def water_level(sources: DataFrame, total: float, max_epochs: float) -> float:
    """Size per unit of weight: clamp sources at their caps and share the excess until nothing
    is above. ``sources``: size, weight. Only sums over all sources reach the driver."""
    cap = max_epochs * F.col("size")
    level, clamped = 0.0, -1
    while True:
        above = (F.col("weight") > 0) & (cap < F.col("weight") * level)
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above & (F.col("weight") > 0), F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            return level if row["weight"] else math.inf
        clamped, level = row["n"], max(level, (total - (row["capped"] or 0.0)) / row["weight"])


def mixing_plan(sized: DataFrame, weights: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of every document) and
    cut (documents whose draw is not above it come once more).

    ``sized``: source, size, draw, read several times; ``weights``: source, weight.
    """
    weights = weights.select(F.col("source").alias("w_source"), "weight")
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = written(
        sizes.join(weights, F.col("source").eqNullSafe(F.col("w_source")), "left").select(
            "source", "n", "size", F.coalesce(F.col("weight"), F.lit(0)).cast("double").alias("weight")
        )
    )
    total = float(sizes.agg(F.sum("size")).first()[0] or 0)
    level = water_level(sizes, total, max_epochs)
    cap = max_epochs * F.col("size")
    share = cap if math.isinf(level) else F.least(cap, F.col("weight") * F.lit(level))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = written(
        sizes.withColumn("target", F.when((F.col("weight") > 0) & (F.col("size") > 0), share).otherwise(0.0))
        .withColumn("whole", whole.cast("long"))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("size"))
        .drop("n", "weight")
    )
    last = cuts_of(sized, plan.filter("quota > 0").select("source", "quota")).withColumnRenamed("source", "l_source")
    return written(
        plan.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left").select(
            "source", F.col("size").alias("source_size"), "target", "whole",
            F.when(F.col("quota") > 0, F.coalesce(F.col("cut"), F.lit(MASK))).otherwise(F.lit(-1)).alias("cut"),
        )
    )


def cuts_of(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """source, cut: the draw up to which the source's sizes come nearest to its quota (``quotas``: source,
    quota). Each round sums by 2^STEP_BITS parts of the range that the quota falls into."""
    state = quotas.withColumns({"low": F.lit(0).cast("long"), "before": F.lit(0).cast("double")})
    bits = DRAW_BITS

    def inside() -> DataFrame:
        s = state.select(F.col("source").alias("s_source"), "quota", "low", "before")
        met = sized.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        return met.filter((F.col("draw") >= F.col("low")) & (F.col("draw") - F.col("low") < F.lit(1 << bits)))

    while True:
        step = min(STEP_BITS, bits)
        part = F.shiftright(F.col("draw") - F.col("low"), bits - step)
        by_part = Window.partitionBy("source").orderBy("part")
        sums = inside().groupBy("source", "quota", "low", "before", part.alias("part")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
        )
        upto = sums.withColumn("upto", F.col("before") + F.sum("size").over(by_part))
        edge = upto.filter((F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("size") <= F.col("quota")))
        bits -= step
        state = written(
            edge.select(
                "source", "quota", (F.col("low") + F.shiftleft("part", bits)).alias("low"), (F.col("upto") - F.col("size")).alias("before"), "n"
            )
        )
        if not bits or (state.agg(F.max("n")).first()[0] or 0) <= BUCKET_DOCS:
            break
    # documents that share a draw are summed first: a draw is taken whole
    draws = inside().groupBy("source", "quota", "before", "draw").agg(F.sum("size").alias("size"))
    ordered = draws.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("draw")))
    # nearest to the quota: a draw counts if at least half of it is within
    return ordered.groupBy("source").agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("quota"), F.col("draw"))).alias("in_cut"),
        (F.min("draw") - 1).alias("no_cut"),
    ).select("source", F.coalesce("in_cut", "no_cut").alias("cut"))


def mix_sources(docs: DataFrame, weights: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and
    mix_copies (how often the mix holds the document; 0 if not at all)."""
    sized = written(
        docs.select("source", words_in(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    )
    return copies_of(docs, mixing_plan(sized, weights, max_epochs), seed)


def copies_of(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    p = plan.select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.col("cut").alias("mix_cut"),
    )
    docs = docs.drop("mix_source", "mix_source_size", "mix_target", "mix_whole", "mix_cut", "mix_size", "mix_copies")
    extra = (draw(F.col("doc_id"), F.col("text"), seed) <= F.col("mix_cut")).cast("long")
    return (
        docs.join(p, F.col("source").eqNullSafe(F.col("mix_source")))
        .withColumn("mix_size", words_in(F.col("text")))
        .withColumn("mix_copies", F.col("mix_whole") + extra)
        .drop("mix_source", "mix_whole", "mix_cut")
    )


def repeated(docs: DataFrame, weights: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is drawn, with its columns."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source",
        words_in(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"),
    )
    plan = mixing_plan(written(rows.drop("row")), weights, max_epochs).select(F.col("source").alias("p_source"), "whole", "cut")
    copies = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("long")
    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select("row", copies.cast("int").alias("copies"))
    return drawn.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def cycled_weights(docs: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """source, weight: the pattern repeated over the sources in code-point order, null last."""
    sources = written(docs.select("source").distinct())
    named = dense_index(sources.filter(F.col("source").isNotNull()), "source", "rank")
    nameless = sources.filter(F.col("source").isNull()).select("source", F.lit(sources.count() - 1).cast("long").alias("rank"))
    chosen = F.get(F.array(*[F.lit(float(w)) for w in pattern]), (F.col("rank") % len(pattern)).cast("int"))
    return named.unionByName(nameless).select("source", chosen.alias("weight"))


def op4_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (see the module's text)."""
    narrow = written(
        docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw"))
    )
    plan = mixing_plan(narrow, cycled_weights(narrow))
    p = plan.withColumnRenamed("source", "p_source")
    copies = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("long")
    return narrow.join(p, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies")
    )

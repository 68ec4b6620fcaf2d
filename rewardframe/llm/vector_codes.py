"""Vector codes: product quantisation whose Lloyd rounds run over cover trees.

Vectors of whole numbers floor(SCALE * x) are cut into PARTS equal parts; each part position has a
codebook of ENTRIES entries, which starts as the parts of the smallest ids and is improved by ROUNDS
rounds of Lloyd's method with whole-number means.

Cover tree: each block of a partition's vectors has one for each part position. A node stands at one
of its points and covers all of its subtree within its radius; its children stand more than the level's
distance apart and cover the node's points within that distance, which halves from level to level.
Subtrees are stretches of the block's points, and cumulative sums give a stretch's count and sum in one
subtraction. A round descends level by level: entries that by the triangle inequality are nearest to no
point of a node are struck out, a node with one entry left is assigned as a whole, and only a leaf with
several left compares its points exactly, in whole numbers. So a round gives just what comparing all
points with all entries gives, ties to the lower index included.

Plan: the blocks with their trees are built once and written; each round reads them, adds up counts and
sums per task, and Spark adds up the tasks' (at most ENTRIES times the width rows each). Only codebooks
pass the driver. The last pass gives codes and errors. Errors of equal labels are summed and joined
back; the join is by label, and a common label's rows are split by adaptive execution.

Defined results: a vector that is null or holds null, NaN or infinite components is left out; a shorter
vector is filled up with 0 to the longest one's width, and that to a multiple of PARTS; ids may repeat
(the smaller vector comes first) and be null (they come last); fewer vectors than ENTRIES make smaller
codebooks; an empty table gives no rows; other columns are not read. A component whose squared
distances could pass 64 bits (whole numbers beyond about 2^27 at 64 components) fails the job by
name, as a wrapped sum would be a wrong result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardframe.llm.common import written
from rewardframe.session import spread

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors and components of one block at most, and points of a node that is not divided.
BLOCK, BLOCK_VALUES, LEAF = 4096, 1 << 20, 24
#: Groups in which the smallest ids are first looked for.
FIRST_GROUPS = 64
#: Slack of compared distances, far above a double's rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """``order``: the points as rows of the block, each subtree a stretch. For each node its point (a
    place in ``order``), its radius, its stretch and its children (a stretch of nodes; none: a leaf)."""

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    child_end: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Cover tree of the rows of ``points`` (whole numbers)."""
    exact = points.astype(np.float64)
    order = np.arange(len(points))

    def distances(rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((exact[rows] - exact[to]) ** 2).sum(axis=1))

    point, radius, start, end, child, child_end, level = [], [], [], [], [], [], []

    def node(a: int, b: int, r: float, size: float) -> None:
        for x, v in ((point, a), (radius, r), (start, a), (end, b), (child, 0), (child_end, 0), (level, size)):
            x.append(v)

    first = distances(order, 0)
    node(0, len(order), float(first.max(initial=0.0)), float(first.max(initial=0.0)))
    at = 0
    while at < len(point):
        a, b, size = start[at], end[at], level[at]
        if b - a > leaf and radius[at] > 0:
            # the node's own point is its first child's; each next child stands at the first point not yet covered
            size = min(size, radius[at]) / 2
            rest, begin = order[a:b].copy(), len(point)
            while len(rest):
                d = distances(rest, rest[0])
                inside = d <= size
                n = int(inside.sum())
                order[a : a + n] = rest[inside]
                node(a, a + n, float(d[inside].max()), size)
                rest, a = rest[~inside], a + n
            child[at], child_end[at] = begin, len(point)
        at += 1
    ints = (np.array(x, dtype=np.int64) for x in (start, end, child, child_end))
    return Tree(order, np.array(point, dtype=np.int64), np.array(radius), *ints)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows, a column for each entry."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # products and sums below 2^53 are exact as doubles, which multiply much faster
    kind = np.float64 if 4 * points.shape[1] * most**2 < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    out = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
    return out.astype(np.int64)


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """Index of each row's nearest entry (ties: the lower), and the number of exact comparisons of a
    point with an entry at leaves. ``points`` are in the tree's order."""
    assigned = np.empty(len(points), dtype=np.int64)
    compared = 0
    nodes, open_ = np.array([0]), np.ones((1, len(entries)), dtype=bool)
    while len(nodes):
        d = np.where(open_, np.sqrt(squared_distances(points[tree.point[nodes]], entries).astype(np.float64)), np.inf)
        r = tree.radius[nodes]
        best = d.min(axis=1)
        # an entry farther than this is no nearest one of any point of the node
        open_ &= d <= (best + 2 * r + SLACK * (1 + best + r))[:, None]
        single = open_.sum(axis=1) == 1
        for n, entry in zip(nodes[single].tolist(), open_[single].argmax(axis=1).tolist()):
            assigned[tree.start[n] : tree.end[n]] = entry
        inner = tree.child[nodes] < tree.child_end[nodes]
        for i in np.flatnonzero(~single & ~inner).tolist():
            a, b, among = tree.start[nodes[i]], tree.end[nodes[i]], np.flatnonzero(open_[i])
            assigned[a:b] = among[squared_distances(points[a:b], entries[among]).argmin(axis=1)]
            compared += (b - a) * len(among)
        down = np.flatnonzero(~single & inner)
        counts = tree.child_end[nodes[down]] - tree.child[nodes[down]]
        firsts = np.repeat(tree.child[nodes[down]] - np.cumsum(counts) + counts, counts)
        nodes, open_ = firsts + np.arange(counts.sum()), np.repeat(open_[down], counts, axis=0)
    return assigned, compared


def entry_sums(tree: Tree, cumulative: np.ndarray, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points nearest to each entry; ``cumulative`` holds the sums of the first
    0, 1, ... points in the tree's order, so stretches of one entry are summed by a subtraction."""
    assigned, _ = assign(tree, points, entries)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(assigned)) + 1, [len(assigned)])) if len(assigned) else np.array([0])
    of = assigned[edges[:-1]]
    counts = np.bincount(of, weights=np.diff(edges), minlength=len(entries)).astype(np.int64)
    sums = np.zeros(entries.shape, dtype=np.int64)
    np.add.at(sums, of, cumulative[edges[1:]] - cumulative[edges[:-1]])
    return counts, sums


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (whole numbers), most (the largest component's amount, scaled) of the rows whose
    vector takes part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return vectors.filter(finite).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"),
        F.array_max(F.transform(x, lambda c: F.abs(c * SCALE))).alias("most"),
    )


def _matrix(vector: pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors as rows of a matrix, shorter ones filled up with 0."""
    flat, lengths = np.asarray(vector.flatten()), np.asarray(vector.value_lengths())
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids and labels as lists, the vectors and each part's tree as bytes."""
    held: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = {c: table.column(c).combine_chunks() if table.num_rows else None for c in ("id", "label", "v")}
        matrix = _matrix(column["v"], width)
        trees = []
        for part in np.split(matrix, PARTS, axis=1):
            t = cover_tree(part)
            trees.append([x.tobytes() for x in (t.order, t.point, t.radius, t.start, t.end, t.child, t.child_end)])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(matrix)], pa.int32()), column[c]) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([matrix.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.list_(pa.binary())))],
            names=["id", "label", "vectors", "trees"],
        )

    have = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - have)
            held.append(part)
            have += part.num_rows
            batch = batch.slice(part.num_rows)
            if have == block:
                yield made(held)
                held, have = [], 0
    if held:
        yield made(held)


def _read(row: dict, width: int) -> tuple[np.ndarray, list[Tree]]:
    kinds = (np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64)
    trees = [Tree(*(np.frombuffer(x, dtype=k) for x, k in zip(t, kinds))) for t in row["trees"]]
    return np.frombuffer(row["vectors"], dtype=np.int64).reshape(len(trees[0].order), width), trees


def _round(batches: Iterator[pa.RecordBatch], width: int, codebooks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The task's count (place -1) and sums (by place in the part) for each part's entry."""
    counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
    sums = [np.zeros(c.shape, dtype=np.int64) for c in codebooks]
    for batch in batches:
        for row in batch.to_pylist():
            matrix, trees = _read(row, width)
            for k, (part, tree) in enumerate(zip(np.split(matrix, PARTS, axis=1), trees)):
                points = part[tree.order]
                cumulative = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points, axis=0)))
                n, s = entry_sums(tree, cumulative, points, codebooks[k])
                counts[k] += n
                sums[k] += s
    for k, (n, s) in enumerate(zip(counts, sums)):
        entry, place = np.meshgrid(np.arange(len(n)), np.arange(-1, s.shape[1]), indexing="ij")
        value = np.concatenate((n[:, None], s), axis=1)
        used = np.repeat(n > 0, s.shape[1] + 1)
        columns = [np.full(used.sum(), k), entry.ravel()[used], place.ravel()[used], value.ravel()[used]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "entry", "place", "value"])


def _coded(batches: Iterator[pa.RecordBatch], width: int, codebooks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])
    for batch in batches:
        for i, row in enumerate(batch.select(["vectors", "trees"]).to_pylist()):
            matrix, trees = _read(row, width)
            code, error = np.full(len(matrix), "", dtype=object), np.zeros(len(matrix), dtype=np.int64)
            for part, tree, entries in zip(np.split(matrix, PARTS, axis=1), trees, codebooks):
                assigned = np.empty(len(part), dtype=np.int64)
                assigned[tree.order], _ = assign(tree, part[tree.order], entries)
                code += digits[assigned].astype(object)
                error += ((part - entries[assigned]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, 1).flatten(), batch.column("label").slice(i, 1).flatten(), pa.array(code, pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"],
            )


def _first(vectors: DataFrame, n: int) -> list:
    """The n rows of smallest ids (null last), then vectors; found by group first, so that no task gets
    the first rows of all partitions."""
    order = [F.col("id").asc_nulls_last(), "v"]
    grouped = vectors.select("id", "v", (F.spark_partition_id() % FIRST_GROUPS).alias("g"))
    by_group = grouped.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("r") <= n)
    return by_group.select("id", "v").orderBy(*order).limit(n).collect()


def codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK
) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code, error of every vector that takes part, and the final codebooks."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col, vector_col, label_col)
    kinds = dict(kept.dtypes)
    have = kept.agg(F.max(F.size("v")).alias("width"), F.max("most").alias("most")).first()
    width = -(-(have.width or 0) // PARTS) * PARTS
    if (have.most or 0) + 1 >= math.sqrt(2.0**63 / (4 * max(1, width))):
        raise ValueError(f"a component of {have.most / SCALE:g} is too large: its squared distances pass 64 bits")
    size = max(1, min(block, BLOCK_VALUES // max(1, width)))
    made = spread(kept.select("id", "label", "v")).mapInArrow(
        lambda it: _blocks(it, width, size),
        f"id array<{kinds['id']}>, label array<{kinds['label']}>, vectors binary, trees array<array<binary>>",
    )
    trees = written(made)
    first = _first(kept, ENTRIES)
    seeds = np.zeros((len(first), width), dtype=np.int64)
    for seed, row in zip(seeds, first):
        seed[: len(row.v)] = row.v
    codebooks = [x.copy() for x in np.split(seeds, PARTS, axis=1)]
    if not first:
        return spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long"), codebooks
    for _ in range(ROUNDS):
        given = codebooks
        added = trees.select("vectors", "trees").mapInArrow(lambda it: _round(it, width, given), "part long, entry long, place long, value long")
        rows = added.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
        counts = {(r.part, r.entry): r.value for r in rows if r.place < 0}
        codebooks = [x.copy() for x in given]
        for r in rows:
            if r.place >= 0:
                codebooks[r.part][r.entry, r.place] = r.value // counts[r.part, r.entry]
    final = codebooks
    coded = trees.mapInArrow(
        lambda it: _coded(it, width, final), f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    )
    return coded, codebooks


def codebook_digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def decoded(coded: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Adds ``vector``: the entries that the codes name, back in the vectors' scale."""
    books = [c / SCALE for c in codebooks]

    @F.arrow_udf("array<double>")
    def vector_of(code: pa.Array) -> pa.Array:
        indexes = np.array([list(bytes.fromhex(x)) for x in code.to_pylist()], dtype=np.int64).reshape(len(code), PARTS)
        rows = np.concatenate([book[indexes[:, k]] for k, book in enumerate(books)], axis=1)
        return pa.array(rows.tolist(), pa.list_(pa.float64()))

    return coded.withColumn("vector", vector_of("code"))


def op12_codes(vectors: DataFrame) -> DataFrame:
    coded, codebooks = codes(vectors)
    coded = written(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """Lloyd's rounds by comparing all parts with all entries; whole numbers as doubles, exact here."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS s FROM kept, range({PARTS}) t(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, s) - 1 AS e, s AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, s) <= {ENTRIES}
)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, parts.p, min({{'d': list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c), 'e': e}}) AS best
  FROM parts JOIN c{k} ON parts.p = c{k}.p GROUP BY r, parts.p
)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT a{k}.p, best.e AS e, i, floor(sum(s[i]) / count(*)) AS m
    FROM a{k} JOIN parts ON a{k}.r = parts.r AND a{k}.p = parts.p, unnest(range(1, len(s) + 1)) u(i) GROUP BY ALL)
  GROUP BY p, e
), c{k + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m{k}.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} ON o.p = m{k}.p AND o.e = m{k}.e
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{ROUNDS}, unnest(range(1, len(c) + 1)) u(i)) AS codebooks_sha256
FROM kept JOIN coded ON kept.r = coded.r"""


ORACLE = _oracle()

"""Nearest neighbours by stable projections, a kd-tree over them and a chi-square stopping test.

Vectors are projected onto a few Gaussian directions. If two vectors lie d apart, their projected distance
squared over d squared follows a chi-square distribution, so once the next projected neighbour is
so far away that a vector within the present k-th distance would almost surely have come before it, the
search stops. Projected neighbours come from kd-trees in order of distance and are verified on
the original vectors.

The tree has two levels. Its upper part, fitted on a bounded sample, deals all vectors to cells; the lower
part is built by the task that holds a cell. A query first searches its home cell, which bounds its k-th
distance, and then only the cells that the stopping test does not rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import importable
from aforo.sources.scratch import stored

#: Directions of the projection (even), and the probability with which a true neighbour must have been met.
DIRECTIONS = 8
CONFIDENCE = 0.99
#: Vectors that the upper tree is fitted on, vectors of a cell, and most cells.
SAMPLE = 20_000
CELL_ROWS = 8_192
MOST_CELLS = 4_096
#: Vectors of a leaf of the lower tree, and queries that meet in one task.
LEAF = 64
QUERY_ROWS = 4_096


def chi_square_quantile(probability: float, degrees: int) -> float:
    """Quantile of the chi-square distribution for an even number of degrees of freedom, by bisection."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while cdf(high) < probability:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if cdf((low + high) / 2) < probability else (low, (low + high) / 2)
    return high


@dataclass(frozen=True)
class Projection:
    """Gaussian directions, one per column, and the upper tree as (axis, value) pairs in heap order."""

    directions: np.ndarray
    splits: tuple[tuple[int, float], ...]

    def project(self, vectors: np.ndarray) -> np.ndarray:
        # One vector at a time, so that equal vectors have equal projections whatever stands beside them.
        return np.stack([vectors @ d for d in self.directions.T], axis=1) if len(vectors) else np.zeros((0, self.directions.shape[1]))

    def cells(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        if not self.splits:
            return node
        axes, values = np.array([s[0] for s in self.splits]), np.array([s[1] for s in self.splits])
        for _ in range(len(self.splits).bit_length()):
            right = projected[np.arange(len(projected)), axes[node]] >= values[node]
            node = 2 * node + 1 + right
            if node.min(initial=0) >= len(self.splits):
                break
        return node - len(self.splits)


def fit(sample: np.ndarray, rows: int, dimensions: int, directions: int = DIRECTIONS, cell_rows: int = CELL_ROWS) -> Projection:
    """Draw the directions and halve the sample along its widest axis until cells are small enough."""
    drawn = np.random.default_rng(17).standard_normal((dimensions, directions))
    depth = min(max(0, math.ceil(math.log2(max(rows, 1) / cell_rows))), MOST_CELLS.bit_length() - 1)
    unsplit = Projection(drawn, ())
    groups, splits = [unsplit.project(sample)], []
    for _ in range(depth):
        halves = []
        for points in groups:
            axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
            value = float(np.median(points[:, axis])) if len(points) else 0.0
            splits.append((axis, value))
            right = points[:, axis] >= value
            halves += [points[~right], points[right]]
        groups = halves
    return Projection(drawn, tuple(splits))


class Tree:
    """The lower kd-tree: leaves with their bounding boxes over rows in leaf order."""

    def __init__(self, projected: np.ndarray):
        order, pending, leaves = np.arange(len(projected)), [(0, len(projected))], []
        while pending:
            a, b = pending.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            points = projected[order[a:b]]
            axis, half = int(np.argmax(np.ptp(points, axis=0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(points[:, axis], half)]
            pending += [(a, a + half), (a + half, b)]
        self.order = order
        self.begins, self.ends = np.array([x[0] for x in leaves]), np.array([x[1] for x in leaves])
        placed = projected[order]
        self.low = np.array([placed[a:b].min(axis=0) for a, b in leaves])
        self.high = np.array([placed[a:b].max(axis=0) for a, b in leaves])

    def leaves_by_distance(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and the least projected distance of anything in them, nearest first."""
        near = box_distance(self.low, self.high, point)
        order = np.argsort(near, kind="stable")
        return order, near[order]


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - point, point - high), 0.0)
    return np.sqrt((gap * gap).sum(axis=1))


def search(
    tree: Tree,
    projected: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    query: np.ndarray,
    point: np.ndarray,
    k: int,
    bound: float,
    reach: float,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of least (distance, id), and their distances, as far as the stopping test lets the search go.

    ``bound`` is a distance within which ``k`` rows are known already; ``reach`` is the projected distance,
    per unit of distance, beyond which a row is almost surely farther.
    """
    found, best = np.zeros(0, dtype=np.int64), np.zeros(0)
    # Rounding must not part equal vectors from each other.
    slack = 1e-9 * (1.0 + float(np.abs(point).max(initial=0.0)))
    leaves, distances = tree.leaves_by_distance(point)
    at, step = 0, 1
    while at < len(leaves):
        limit = reach * bound * (1 + 1e-9) + slack
        upto = min(at + step, int(np.searchsorted(distances, limit, side="right")))
        if upto <= at:
            break
        rows = np.concatenate([tree.order[tree.begins[i] : tree.ends[i]] for i in leaves[at:upto]])
        gap = projected[rows] - point
        rows = rows[np.sqrt((gap * gap).sum(axis=1)) <= limit]
        away = vectors[rows] - query
        rows, met = np.concatenate([found, rows]), np.concatenate([best, np.sqrt((away * away).sum(axis=1))])
        order = np.lexsort((ids[rows], met))[:k]
        found, best = rows[order], met[order]
        if len(best) == k:
            bound = min(bound, float(best[-1]))
        at, step = upto, min(2 * step, 64)
    return found, best


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
    scratch: str | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the neighbour's key and ``score``, its Euclidean distance in double precision.

    ``queries`` has the same key and vector columns; a row is no neighbour of a query with its own key.
    Ties go to the smaller key. Vectors that are NULL, zero, of another length than most distinct
    ones (of tied lengths the larger), or that hold NULL or a non-finite number take no part on either side, nor do NULL keys; with fewer than
    ``k`` candidates all are returned. Rows of one key and vector count once. Other columns are not looked at.

    Equal vectors are one point of the index, which names their ``k + 1`` smallest keys: no other can be
    among a query's ``k``. Likewise, equal query vectors are searched once.
    """
    spark = df.sparkSession
    importable(spark)
    points = _valid(df, key, vector)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    named = points.distinct().withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    index = stored(named.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-index", scratch)
    # One row per length that occurs.
    lengths = index.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    asked = _valid(queries, key, vector)
    empty = "query_id long, rank int, vec_id long, score double".replace("vec_id", f"`{key}`")
    if usual is None:
        return spark.createDataFrame([], empty)
    dimensions, rows = usual.length, usual.rows
    same = F.size("v") == dimensions
    chosen = index.filter(same).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").collect()
    fitted = fit(np.array([r.v for r in chosen]), rows, dimensions, directions, cell_rows)
    reach = math.sqrt(chi_square_quantile(confidence, directions))

    dealt = stored(_dealt(index.filter(same), fitted), "ann-dealt", scratch)
    # Cells that the sample has misjudged are cut into parts, by a hash of the vector.
    cells = dealt.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / (2 * cell_rows)).cast("int").alias("parts"),
        *(f(F.col("p")[i]).alias(f"{n}{i}") for i in range(directions) for n, f in (("low", F.min), ("high", F.max))),
    )
    boxes = cells.collect()  # one row per cell, at most MOST_CELLS
    asked = stored(_dealt(asked.filter(same).groupBy("v").agg(F.lit(0).alias("ids")), fitted).drop("ids"), "ann-queries", scratch)
    asked = asked.withColumn("q", F.xxhash64("v"))

    parts = spark.createDataFrame([(b.cell, b.parts) for b in boxes], "cell long, parts int")
    blocks = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).drop("parts")
    chunks = max(1, math.ceil(asked.count() / query_rows))

    home = asked.withColumn("bound", F.lit(float("inf")))
    first = stored(_searched(home, blocks, parts, chunks, k + 1, reach), "ann-home", scratch)
    bounds = first.groupBy("q").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    bounds = bounds.select("q", F.get("ds", F.lit(k)).alias("bound"))
    away = asked.join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = _searched(_elsewhere(away, boxes, directions, reach), blocks, parts, chunks, k + 1, reach)

    both = first.unionByName(second).withColumn("_rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id")))
    kept = both.filter(F.col("_rank") <= k + 1).select("q", "id", "d")
    who = _valid(queries, key, vector).distinct().select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q"))
    answers = who.join(kept, "q").filter("query_id != id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return answers.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), F.col("d").alias("score")
    )


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _dealt(rows: DataFrame, fitted: Projection) -> DataFrame:
    """Add ``p``, the projection, and ``cell``."""
    kind = rows.schema["ids"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                projected = fitted.project(np.stack(frame["v"].to_numpy()))
                yield frame.assign(p=list(projected), cell=fitted.cells(projected))

    return rows.select("v", "ids").mapInPandas(run, f"v array<double>, ids {kind}, p array<double>, cell long")


def _elsewhere(asked: DataFrame, boxes: list, directions: int, reach: float) -> DataFrame:
    """One row per query and cell, other than its home, that the stopping test does not rule out."""
    cells = np.array([b.cell for b in boxes])
    low = np.array([[b[f"low{i}"] for i in range(directions)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(directions)] for b in boxes])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                near = cells[box_distance(low, high, row.p) <= reach * row.bound * (1 + 1e-9) + 1e-9 * (1 + np.abs(row.p).max())]
                near = near[near != row.cell]
                if len(near):
                    yield pd.DataFrame({"v": [row.v] * len(near), "p": [row.p] * len(near), "cell": near, "q": row.q, "bound": row.bound})

    columns = asked.select("v", "p", "cell", "q", "bound")
    return columns.mapInPandas(run, "v array<double>, p array<double>, cell long, q long, bound double")


def _searched(asked: DataFrame, blocks: DataFrame, parts: DataFrame, chunks: int, k: int, reach: float) -> DataFrame:
    """``q``, ``id``, ``d``: each query's best rows of each part of the cells it asks."""
    numbers = F.broadcast(parts)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    every_part, every_chunk = F.sequence(zero, F.col("parts") - one), F.sequence(zero, F.lit(chunks) - one)
    posed = asked.join(numbers, "cell").select(
        "cell", F.explode(every_part).alias("part"), F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("chunk"), "q", "v", "p", "bound"
    )
    spread = blocks.select("cell", F.col("part").cast("long").alias("part"), F.explode(every_chunk).alias("chunk"), "v", "p", "ids")

    def run(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(queries):
            return pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64", "d": "float64"})
        vectors, projected = np.stack(cell["v"].to_numpy()), np.stack(cell["p"].to_numpy())
        names = cell["ids"].to_numpy()
        smallest = np.array([n[0] for n in names])
        tree, found = Tree(projected), []
        for row in queries.itertuples():
            at, distances = search(tree, projected, vectors, smallest, np.asarray(row.v), np.asarray(row.p), k, row.bound, reach)
            found += [(row.q, i, d) for n, d in zip(at.tolist(), distances.tolist()) for i in names[n]]
        return pd.DataFrame(found, columns=["q", "id", "d"]).astype({"q": "int64", "id": "int64", "d": "float64"})

    keys = ["cell", "part", "chunk"]
    return spread.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInPandas(run, "q long, id long, d double")

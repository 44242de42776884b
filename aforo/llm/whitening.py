"""Whitening of embeddings by polarisation of variances.

Vectors become whole numbers, and each is centred at the whole part of its dimension's mean. For every
dimension, and for the sum of every pair of dimensions, the squares of the centred values are added up exactly.
A sum's variance holds its parts' covariance twice, so half the difference of variances is the covariance:

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

The fraction by which a centre misses the mean is known exactly and taken out as such, so that the
matrix is the exact one, rounded once. Its eigenvectors are found on the driver, which sees numbers by
dimension or pair only, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.llm.common import fields, importable, map_batches, slices
from aforo.sources.scratch import stored

#: Whole numbers are ``floor(SCALE * entry) + SHIFT``.
SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows whose pair sums are held at once.
ROWS_AT_ONCE = 1024
#: Entries beyond this size have no place in 64 bits once scaled and centred.
MOST = 2.0**55

EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """What was learned: rows, sums by dimension, variances (falling) and unit directions as columns."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    total: float

    @property
    def centres(self) -> np.ndarray:
        """The whole parts of the means."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def remainders(self) -> np.ndarray:
        """What ``n`` times a whole part leaves of the sum: less than ``n``."""
        return np.array([s % self.n for s in self.sums], dtype=np.int64)


def _sound(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not empty and holds neither NULL nor anything that is not finite."""
    return df.filter(F.size(vector) > 0).filter(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= MOST, F.lit(False))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers from a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE)).astype(np.int64).reshape(len(column), -1) + SHIFT


def _summed(df: DataFrame, column: str, function: Callable[[pa.Array], np.ndarray], kind: str) -> list:
    """The sums by place of the lists that ``function`` makes of every few rows.

    A task adds up its own, Spark those of the tasks. The result has as many numbers as one such list.
    """
    importable(df.sparkSession)
    as_sum = Decimal if kind == EXACT else float
    arrow = pa.schema([("place", pa.int32()), ("value", pa.decimal128(38, 0) if kind == EXACT else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch):
                found = function(part.column(0))
                total = found if total is None else total + found
        if total is not None:
            places = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"place": places, "value": [as_sum(v) for v in total.tolist()]}, schema=arrow)

    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("value", T.DataType.fromDDL(kind))])
    parts = df.select(column).mapInArrow(run, schema)
    totals = parts.groupBy("place").agg(F.sum("value").cast(kind).alias("value")).orderBy("place")
    return totals.toArrow().column("value").to_pylist()


def _exact_sums(values: np.ndarray) -> np.ndarray:
    """Sums down the columns as Python's integers, which do not overflow."""
    return values.sum(axis=0, dtype=object) if _overflows(values, 1) else values.sum(axis=0).astype(object)


def _overflows(values: np.ndarray, power: int) -> bool:
    most = max(abs(int(values.max())), abs(int(values.min())))
    return most**power * len(values) >= 1 << 62


def pair_squares(centred: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of all pair sums, i <= j row by row; a dimension with itself counts once, not doubled."""
    d = centred.shape[1]
    wide = _overflows(2 * centred, 2)
    found = np.zeros(d * (d + 1) // 2, dtype=object)
    at = 0
    for i in range(d):
        both = centred[:, i:] + centred[:, i : i + 1]
        both[:, 0] = centred[:, i]
        found[at : at + d - i] = (both.astype(object) ** 2).sum(axis=0) if wide else np.einsum("ij,ij->j", both, both)
        at += d - i
    return found


def covariance(squares: list[int], remainders: np.ndarray, n: int) -> np.ndarray:
    """The matrix from the sums of ``pair_squares``; exact until each entry is rounded to a double."""
    d = len(remainders)
    offsets = [int(r) for r in remainders]
    # n**2 times the variances of dimensions and of sums of two, in order of the pairs.
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    scaled = {}
    for (i, j), square in zip(pairs, squares, strict=True):
        offset = offsets[i] if i == j else offsets[i] + offsets[j]
        scaled[i, j] = n * int(square) - offset**2
    matrix = np.empty((d, d))
    for i, j in pairs:
        twice = 2 * scaled[i, i] if i == j else scaled[i, j] - scaled[i, i] - scaled[j, j]
        matrix[i, j] = matrix[j, i] = float(Fraction(twice, 2 * n * n))
    return matrix


def _directions(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest variances, falling, and their unit directions; none that is zero up to rounding."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > len(matrix) * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[real], vectors[:, real]
    # The sign is free; the largest entry of each is made positive.
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def fit(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all rows, which hold vectors of one length; None where there is no row."""
    sums = _summed(vectors, vector, lambda column: _exact_sums(np.column_stack([_matrix(column), np.ones(len(column), np.int64)])), EXACT)
    if not sums:
        return None
    *sums, n = map(int, sums)
    blank = Whitening(n, tuple(sums), np.empty(0), np.empty((len(sums), 0)), 0.0)
    centres = blank.centres

    def squares(column: pa.Array) -> np.ndarray:
        rows = _matrix(column) - centres
        return sum(pair_squares(rows[i : i + ROWS_AT_ONCE]) for i in range(0, len(rows), ROWS_AT_ONCE))

    matrix = covariance(_summed(vectors, vector, squares, EXACT), blank.remainders, n)
    return Whitening(n, tuple(sums), *_directions(matrix, components), float(np.trace(matrix)))


def _whitened(vectors: DataFrame, vector: str, model: Whitening) -> DataFrame:
    """The rows with ``deviation`` and ``whitened`` instead of the vector."""
    kept = [c for c in vectors.columns if c != vector]
    centres, remainders, n = model.centres, model.remainders, model.n
    projection = model.directions / np.sqrt(model.variances)

    def run(batch):
        rows = _matrix(batch.column(vector)) - centres
        # n times what is centred can leave 64 bits, and its square soon does.
        wide = (int(np.abs(rows).max()) + 1) * n >= 1 << 62
        exact = rows.astype(object) * n - remainders if wide else rows * n - remainders
        if not wide and int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 62:
            exact = exact.astype(object)
        deviations = [Decimal(int(v)) for v in (exact * exact).sum(axis=1)]
        white = (rows - remainders / n) @ projection
        return {c: batch.column(c) for c in kept} | {"deviation": deviations, "whitened": list(white)}

    return map_batches(vectors, run, fields(vectors, [vector], deviation=EXACT, whitened="array<double>"))


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    if not components:
        return 0.0

    def rows(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), components)

    means = np.array(_summed(white, "whitened", lambda column: rows(column).sum(axis=0), "double")) / n

    def products(column: pa.Array) -> np.ndarray:
        centred = rows(column) - means
        return (centred.T @ centred).ravel()

    found = np.array(_summed(white, "whitened", products, "double")).reshape(components, components) / n
    return float(np.abs(found - np.eye(components)).max())


def usual_length(df: DataFrame, vector: str) -> int | None:
    """The most frequent length among the vectors, of equally frequent ones the greatest."""
    counts = df.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    first = counts.orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
    return first[0].length if first else None


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scratch: str | None = None) -> DataFrame:
    """``key``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every sound row.

    ``whitened`` and ``explained`` are arrays, one number per component by falling variance: the row
    projected over the component's deviation, and the component's share of all variance. ``n`` counts the sound rows,
    ``deviation`` is the exact sum over dimensions of ``(n * x - sum)**2``, as a decimal of 38 digits, and
    ``identity_error`` is measured on the whitened rows.

    Rows whose vector is NULL or empty, or holds a NULL, a NaN, an infinity or an entry beyond 2**55, take no
    part, nor do vectors of another length than the most frequent. Rows are judged each, so repeated ids
    and vectors, and NULL ids, return as often as they occur. Directions without variance, as in tables of fewer rows than
    dimensions or of equal rows, are no components; an empty table gives an empty result. Other columns are
    not looked at. Equal variances have directions in the order of the eigenvalue routine.
    """
    sound = _sound(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector")), "_vector")
    sound = sound.filter(F.size("_vector") == (usual_length(sound, "_vector") or 0))
    model = fit(sound, "_vector", components)
    if model is None:
        shape = fields(sound, ["_key", "_vector"], n="long", deviation=EXACT, whitened="array<double>", explained="array<double>", identity_error="double")
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(key, df.schema[key].dataType), *shape]))
    white = stored(_whitened(sound, "_vector", model), "whitening", scratch)
    error = identity_error(white, model.n, len(model.variances))
    shares = (model.variances / model.total).tolist() if model.total else []
    return white.select(
        F.col("_key").alias(key),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def by_component(white: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row for each row of ``whiten`` and component: ``component`` counts from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_place", "_one")
    return white.select(F.col(f"`{key}`"), "n", "deviation", "identity_error", each).select(
        F.col(f"`{key}`"),
        (F.col("_place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("_one.whitened").alias("whitened"),
        F.col("_one.explained").alias("explained"),
        "identity_error",
    )

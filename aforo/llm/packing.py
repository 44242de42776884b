"""Documents packed into sequences of tokens along a space-filling curve.

A document's tokens are counted in a hashed vector, which a fixed random projection brings to few dimensions. The
Hilbert key of that point is a place on a curve that keeps neighbours together, so documents
sorted by it lie next to similar ones. They are laid end to end along the curve and cut every so many
tokens; only the last sequence can be short.

Spark sorts by ranges of the key. A task adds up the tokens of its range, the sums of whole ranges are added from a
table with a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from aforo.llm.bpe import Vocabulary
from aforo.llm.byteids import ByteEncoder
from aforo.llm.common import fields, importable, kept_by_worker, map_batches
from aforo.sources.scratch import stored

#: Entries of the hashed vectors, dimensions that they are projected to, and bits of each in the key.
HASHED = 4096
DIMENSIONS = 4
BITS = 15
#: Tokens that a range is planned for, and the fewest for which a further range is worth while.
TOKENS_PER_RANGE = 16 << 20
LEAST_PER_RANGE = 1 << 20
#: The table of ranges is broadcast: it has no more rows than this. Beyond, ranges grow.
MOST_RANGES = 100_000

_PROJECTION = np.random.default_rng(20250211).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates of so many bits, one point a row."""
    x = points.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    step = top
    while step > 1:
        low = step - 1
        for row in x:
            high = (row & step) != 0
            swapped = np.where(high, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(high, low, swapped)
            row ^= swapped
        step >>= 1
    for before, row in zip(x, x[1:]):
        row ^= before
    turned = np.zeros_like(x[0])
    step = top
    while step > 1:
        turned ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turned
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> bit & 1)
    return key


class Placer:
    """Points of documents from their token ids; one per worker."""

    def __init__(self, ids: int):
        mixed = np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self._slot = (mixed >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        """Hilbert keys. Counts enter by their roots and vectors have length 1, so that neither frequent tokens
        nor long documents decide alone."""
        vectors = np.zeros((len(documents), HASHED), dtype=np.float32)
        for vector, ids in zip(vectors, documents):
            counts = np.sqrt(np.bincount(self._slot[ids], minlength=HASHED))
            vector[:] = counts / max(1.0, np.sqrt(counts @ counts))
        # A fixed slope spreads the projected values over the grid, whatever the other documents are.
        share = 1.0 / (1.0 + np.exp(-1.702 * (vectors @ _PROJECTION).astype(np.float64)))
        return hilbert_key(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class _Reader:
    def __init__(self, vocabulary: Vocabulary):
        self.encoder = ByteEncoder(vocabulary)
        self.placer = Placer(1 + max([*vocabulary.tokens, *vocabulary.special.values()]))


def _width(vocabulary: Vocabulary, end: int) -> str:
    """How ids are kept while they move: 16 bits where all fit, else 32."""
    return "<u2" if max([end, *vocabulary.tokens, *vocabulary.special.values()]) < 1 << 16 else "<u4"


def _encoded(df: DataFrame, vocabulary: Vocabulary, end: int) -> DataFrame:
    """``_key``, ``_n`` and ``_ids`` (with ``end``, as narrow as they go) of each row, and its ``_place`` on the curve."""
    width = _width(vocabulary, end)

    def run(batch):
        reader = kept_by_worker(("packing", len(vocabulary.tokens), hash(vocabulary.merges)), lambda: _Reader(vocabulary))
        documents = [reader.encoder.ids(t or "") for t in batch.column("_text").to_pylist()]
        whole = [np.append(ids, np.uint32(end)).astype(width) for ids in documents]
        out = {"_key": batch.column("_key"), "_n": [len(ids) for ids in whole], "_ids": [ids.tobytes() for ids in whole]}
        return out | {"_place": reader.placer.keys(documents)}

    return map_batches(df, run, fields(df, ["_text"], _n="long", _ids="binary", _place="long"))


def _with_running_sum(df: DataFrame) -> DataFrame:
    """Each row with its range, ``_range``, and the tokens before it in there. Rows come sorted, a range to a task."""
    importable(df.sparkSession)
    schema = fields(df, _range="int", _before="long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, passed = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = passed + np.cumsum(batch.column("_n").to_numpy())
            before = np.concatenate([[passed], upto])[:-1]
            passed = int(upto[-1]) if len(upto) else passed
            columns = [*batch.columns, pa.array(np.full(len(before), number, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def _ranges(total: int, tasks: int) -> int:
    spread = min(total // LEAST_PER_RANGE, 4 * tasks)
    return min(max(1, spread, -(-total // TOKENS_PER_RANGE)), MOST_RANGES)


def _in_order(tokens: DataFrame, scratch: str | None) -> DataFrame:
    """The rows with ``_start``, the tokens before each along the whole curve. Equal places go by a hash of id
    and tokens, so that a range never has to hold all copies of a document."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("_n").alias("n")).collect()[0].n or 0
    ranges = _ranges(total, spark.sparkContext.defaultParallelism)
    order = ("_place", "_tie")
    along = tokens.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    along = stored(_with_running_sum(along), "packing-sorted", scratch)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = along.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return along.join(F.broadcast(offsets), "_range").withColumn("_start", F.col("_offset") + F.col("_before"))


def _cut(placed: DataFrame, width: str, length: int) -> DataFrame:
    """The pieces of each row: ``_key`` and the other columns of ``pack``."""
    kinds = {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
    given = placed.select("_key", "_start", "_ids")

    def run(batch):
        rows, pieces = [], []
        for i, (begin, raw) in enumerate(zip(batch.column("_start").to_pylist(), batch.column("_ids"))):
            ids = np.frombuffer(raw.as_buffer(), width)
            at = 0
            while at < len(ids):
                sequence, offset = divmod(begin + at, length)
                piece = ids[at : at + length - offset]
                rows.append(i)
                pieces.append((at, len(piece), piece.astype("<u4").tobytes(), len(ids), sequence, offset))
                at += len(piece)
        return {"_key": batch.column("_key").take(pa.array(rows, pa.int32())), **dict(zip(kinds, zip(*pieces)))}

    return map_batches(given, run, fields(given, ["_start", "_ids"], **kinds))


def pack(
    df: DataFrame,
    vocabulary: Vocabulary,
    length: int = 2048,
    end: int = 1,
    text: str = "text",
    key: str = "doc_id",
    scratch: str | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence: ``key``, ``start`` (the document's tokens before it),
    ``length``, ``ids`` (32-bit, little-endian), ``doc_tokens``, ``sequence_id`` and ``offset`` (the sequence's
    tokens before it).

    A document is the tokens of its whole text, then the id ``end``; a NULL or empty text is that id alone.
    Sequences hold ``length`` tokens, filled without gaps, but for the last one. Rows are packed each, also
    repeated ones, which lie next to each other, and those without an id. Order along the curve is by Hilbert key, then by a
    hash; rows alike in both are the same in id and tokens. An empty table gives an empty result; other columns
    are not looked at. Tokens move once, to the range of their key.
    """
    given = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    tokens = _encoded(given, vocabulary, end).withColumn("_tie", F.xxhash64("_key", "_ids"))
    placed = _in_order(stored(tokens, "packing-tokens", scratch), scratch)

    return _cut(placed, _width(vocabulary, end), length).withColumnRenamed("_key", key)

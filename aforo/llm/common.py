"""Helpers shared by the operators: reading tables, words, distributed running sums, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: a word, for counting and shingling.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that one window or one group of a task is meant to hold.
ROWS_PER_BUCKET = 50_000
#: Rows, and bytes unless one row alone has more, of an Arrow batch that a worker holds as Python objects.
ROWS_AT_ONCE = 1024
BYTES_AT_ONCE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def bits_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bits of a uniform hash that cut ``rows`` into buckets of at most about ``per_bucket``."""
    return max(0, -(-max(rows, 1) // per_bucket) - 1).bit_length()


def top_bits(hashed: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit hash, as a number that keeps the order of the hash."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.shiftright(hashed, 64 - bits)


def running_sum(
    df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row.

    ``bucket`` columns must follow the order and be fine enough for a task: only a bucket's rows
    meet in one window, and the sums of whole buckets are added from an aggregated table. The
    key columns must not be NULL.
    """
    keys = [*group, *bucket]
    rows = df.withColumn("_value", value)
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_offset")
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough where the path holds on the executors too, as in local mode; else ship it with ``--py-files``. Batches
    come from the system's allocator, which gives a freed one back, unless the session says otherwise.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    environment.setdefault("MALLOC_ARENA_MAX", "2")


_kept: dict[tuple, object] = {}


def kept_by_worker(key: tuple, make: Callable[[], object]):
    """What ``make`` builds, kept until another operator's task comes to this worker: a worker serves many
    tasks of one operator, and later those of others, which need the memory."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            _give_back()
        _kept[key] = make()
    return _kept[key]


def _give_back() -> None:
    """What was freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes; a row that is larger comes alone."""
    half = batch.num_rows // 2
    if half and (batch.num_rows > ROWS_AT_ONCE or batch.nbytes > BYTES_AT_ONCE):
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """Apply ``function`` to Arrow batches; it returns the output columns by name, as Arrow arrays or lists.

    A worker lets go of a batch before it reads the next one, and of what a task has freed when the task ends.
    """
    importable(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(function(part), schema=arrow)
            batch = part = None
        _give_back()

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, without: Sequence[str] = (), **added: str) -> T.StructType:
    """The columns of ``df`` but some, and added ones by name and type."""
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in without]
    return T.StructType([*kept, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in added.items())])

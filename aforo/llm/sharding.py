"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Documents are ordered by (hash of the text, hash of the id, id), so equal texts lie side by side.
Splitters between the shards are found on a narrow stored table, by counting the exact bytes
below candidate boundaries and refining the candidates around each target until it is met within
the tolerance. Only then do the documents move, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import ROWS_PER_BUCKET, bits_for, running_sum
from aforo.sources.scratch import stored

#: Largest distance of a boundary from its target, as a share of a shard.
TOLERANCE = 0.005
#: Candidates per splitter and round: 2 to this power.
PROBE_BITS = 12

_LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """Keys from (text_hash, id_hash) on belong to the shard above; ``below`` bytes lie beneath."""

    text_hash: int
    id_hash: int
    below: int

    def reached(self, text_hash: Column, id_hash: Column) -> Column:
        at = F.lit(self.text_hash)
        return (text_hash > at) | ((text_hash == at) & (id_hash >= F.lit(self.id_hash)))


def _keys(df: DataFrame, text: str, key: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    return df.withColumns({"_h": F.xxhash64(F.col(text)), "_u": F.xxhash64(F.col(key)), "_size": size})


@dataclass
class _Search:
    """One splitter's open interval: on ``_h`` first, on ``_u`` once a single text fills it."""

    target: int
    low: int  # first key of the interval
    bits: int  # its width is 2 ** bits
    below: int
    text: int | None = None  # the text hash that is being split
    found: Splitter | None = None

    def boundary(self, key: int, below: int) -> Splitter:
        return Splitter(key, _LOWEST, below) if self.text is None else Splitter(self.text, key, below)


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """The ``shards - 1`` boundaries for a stored table of ``_h``, ``_u``, ``_size``.

    Each round reads the narrow table once and brings back at most ``shards * 2**PROBE_BITS`` sums,
    whatever the number of rows. A boundary lies between two texts wherever that meets the
    tolerance; only a group of equal texts too large for it is split, by the hash of the ids. Where no
    boundary is within the tolerance, because one document is larger, the nearest is taken.
    """
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    allowed = tolerance * total / shards
    searches = [_Search(total * j // shards, _LOWEST, 64, 0) for j in range(1, shards)]
    while open_ := [s for s in searches if s.found is None]:
        intervals = list({(s.text, s.low, s.bits): None for s in open_})
        counts = _histograms(keyed, intervals)
        for s in open_:
            _refine(s, counts.get((s.text, s.low, s.bits), []), allowed)
    return [s.found for s in searches]


def _histograms(keyed: DataFrame, intervals: list[tuple[int | None, int, int]]) -> dict:
    """Bytes per candidate cell of each interval: lists of (cell, bytes, least and largest text hash)."""
    number, cell, inside = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
    for i, (text, low, bits) in enumerate(intervals):
        column = F.col("_h") if text is None else F.col("_u")
        within = column.between(F.lit(low), F.lit(low + (1 << bits) - 1))
        if text is not None:
            within = within & (F.col("_h") == F.lit(text))
        step = max(0, bits - PROBE_BITS)
        # Both sides are shifted before the difference is taken, which therefore fits.
        steps = F.shiftright(column, step) - F.lit(low >> step)
        number, cell = F.when(within, F.lit(i)).otherwise(number), F.when(within, steps).otherwise(cell)
        inside = inside | within
    sums = (
        keyed.filter(inside)
        .groupBy(number.alias("interval"), cell.alias("cell"))
        .agg(F.sum("_size").alias("size"), F.min("_h").alias("least"), F.max("_h").alias("most"))
    )
    found: dict = {}
    for row in sums.collect():
        found.setdefault(intervals[row.interval], []).append((row.cell, row["size"], row.least, row.most))
    return {k: sorted(v) for k, v in found.items()}


def _refine(s: _Search, cells: list, allowed: float) -> None:
    """Close the search at a boundary near enough, or narrow it to the cell that holds the target."""
    step = max(0, s.bits - PROBE_BITS)
    below = s.below
    for cell, size, least, most in cells:
        if below + size < s.target:
            below += size
            continue
        low, above = s.low + (cell << step), below + size
        near = (low, below) if s.target - below <= above - s.target else (low + (1 << step), above)
        end_of_keys = near[0] >= -_LOWEST
        if abs(near[1] - s.target) <= allowed and not end_of_keys:
            s.found = s.boundary(*near)
        elif step > 0:
            s.low, s.bits, s.below = low, step, below
        elif s.text is None:
            # One text hash is left: split its documents by their ids.
            s.text, s.low, s.bits, s.below = low, _LOWEST, 64, below
        else:
            s.found = s.boundary(low, below) if end_of_keys else s.boundary(*near)
        if s.found is None and s.text is None and least == most and s.bits < 64:
            s.text, s.low, s.bits = least, _LOWEST, 64
        return
    s.found = Splitter(-_LOWEST - 1, -_LOWEST - 1, below)


def shard_by_bytes(
    df: DataFrame,
    shards: int = 8,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = TOLERANCE,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    scratch: str | None = None,
) -> DataFrame:
    """The rows with ``size``, ``shard`` and ``slot``; the law is that shards have near equal bytes.

    A row's size is the UTF-8 bytes of its text (none for NULL) plus one. ``slot`` numbers a shard's
    rows from 0 without gaps, in key order. Equal texts are neighbours and share a shard unless a
    boundary has to cut their group. NULL texts and ids hash to fixed values and are ordinary rows,
    empty texts have size 1, equal rows are counted each, and an empty table gives an empty result.
    Columns called ``size``, ``shard`` or ``slot`` are replaced; all others are carried along.

    Neither a shard nor a group of equal texts meets in one task: rows are ordered in buckets cut from
    the leading bits of the keys, finer where many rows fall, and slots are counted from bucket sums. Only rows
    equal in text and id are never parted.
    """
    carried = [c for c in df.columns if c not in ("size", "shard", "slot")]
    keyed = _keys(df.select(*(F.col(f"`{c}`") for c in carried)), f"`{text}`", f"`{key}`")
    narrow = stored(keyed.select("_h", "_u", "_size"), "shards", scratch)
    splitters = find_splitters(narrow, shards, tolerance)

    def shard(h: Column, u: Column) -> Column:
        return sum((s.reached(h, u).cast("int") for s in splitters), F.lit(0))

    bits = bits_for(narrow.count(), rows_per_bucket)
    coarse = F.lit(0).cast("long") if bits == 0 else F.shiftright("_h", 64 - bits)
    # Cells with many more rows than planned are cut again by the next bits; and among their texts those that alone
    # hold so many, by the ids. All shards count: of a text that a boundary cuts, each has a part of the ids' range only.
    texts = narrow.groupBy(coarse.alias("_cell"), "_h").agg(F.count(F.lit(1)).alias("_rows"))
    cut = F.ceil(F.log2(F.col("_rows") / rows_per_bucket)).cast("int")
    hot = F.when(F.col("_rows") > 2 * rows_per_bucket, F.struct(F.col("_h").alias("h"), cut.alias("bits")))
    crowded = (
        texts.groupBy("_cell")
        .agg(F.sum("_rows").alias("_rows"), F.collect_list(hot).alias("_hot"))
        .filter(F.col("_rows") > 2 * rows_per_bucket)
        .select("_cell", cut.alias("_bits"), "_hot")
    )
    # One row per crowded cell: at most one for 2 * rows_per_bucket rows.
    zero = F.lit(0).cast("long")
    fine = F.when(F.col("_bits").isNull(), zero).otherwise(
        # shiftright keeps the sign, and so the order.
        F.expr("shiftrightunsigned(shiftleft(_h, {0}), 64 - _bits)".format(bits)) if bits else F.expr("shiftright(_h, 64 - _bits)")
    )
    # Hot texts have odd numbers, those between them even ones.
    among = F.coalesce(F.expr("2 * size(filter(_hot, x -> x.h < _h)) + int(exists(_hot, x -> x.h = _h))"), F.lit(0))
    part = F.coalesce(F.expr("shiftright(_u, 64 - get(filter(_hot, x -> x.h = _h), 0).bits)"), zero)
    rows = keyed.withColumns({"_shard": shard(F.col("_h"), F.col("_u")), "_cell": coarse})
    rows = rows.join(F.broadcast(crowded), "_cell", "left").withColumns({"_fine": fine, "_among": among, "_part": part}).drop("_bits", "_hot")
    order = [F.col("_h"), F.col("_u"), F.col(f"`{key}`")]
    placed = running_sum(rows, ["_shard"], ["_cell", "_fine", "_among", "_part"], order, F.lit(1).cast("long"), "_slot")
    return placed.select(
        *(F.col(f"`{c}`") for c in carried),
        F.col("_size").alias("size"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result as one folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)

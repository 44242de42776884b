"""Exact median by group for groups of any size.

The built-in ``median`` keeps all distinct values of a group in one task's memory. Here a first
pass computes, next to the other statistics, a quantile sketch whose guaranteed error brackets
the median of each group. A second pass counts rows below and above the bracket by group, and rows inside
it by value. While a group's bracket holds more different values than may be gathered, it is
narrowed by ranks: quantiles of the different values cut it into cells of nearly equally many, whatever the
values are, and the rows of the cells tell which one holds the middle ranks. Only the values left are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.functions.values import is_floating, nan_to_null
from aforo.operators.stats import Stat
from aforo.sources.scratch import stored

SKETCH_ACCURACY = 10_000
# The sketch errs by at most 1/accuracy of the ranks; five times that keeps the median inside.
BRACKET = 5 / SKETCH_ACCURACY
#: Different values of a group that are gathered into one list and ordered.
MOST_VALUES = 10_000
#: Cells that a round of narrowing cuts a group's values into, and how much finer than a cell the cuts are.
CELLS = 64
FINER = 100

KEYS = ("_group", "_measure", "_which")


def _number(df: DataFrame, measure: str) -> Column:
    """The measure as a double, NULL where missing."""
    column = F.col(f"`{measure}`").cast("double")
    return nan_to_null(column) if is_floating(df.schema[measure].dataType) else column


def _first_pass(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat], measures: Sequence[str]) -> DataFrame:
    """One row per group: the mergeable statistics and the bracket of each median.

    Stored, so that group numbers are fixed and Spark knows the true size when it joins.
    """
    columns = [s.column() for s in stats]
    for i, measure in enumerate(measures):
        ends = F.percentile_approx(_number(df, measure), [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY)
        columns += [ends[0].alias(f"_low{i}"), ends[1].alias(f"_high{i}")]
    groups = df.groupBy(*keys).agg(*columns)
    return stored(groups.select("*", F.monotonically_increasing_id().alias("_group")), "median")


def _side(i: int) -> Column:
    """Where a value lies: below its bracket (-1), above it (1) or inside (0)."""
    value, low, high = F.col(f"_v{i}"), F.col(f"_low{i}"), F.col(f"_high{i}")
    return F.when(value < low, F.lit(-1)).when(value > high, F.lit(1)).otherwise(F.lit(0))


def _counts(df: DataFrame, groups: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows by group, measure, side and, inside the bracket, value. Stored: it is read again and small."""
    values = df.select(
        *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)),
        *(_number(df, m).alias(f"_v{i}") for i, m in enumerate(measures)),
    )
    brackets = groups.select(
        *(F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)),
        "_group",
        *(f"_{end}{i}" for i in range(len(measures)) for end in ("low", "high")),
    )
    same_group = [F.col(f"_k{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(keys))]
    joined = values.join(brackets, same_group)
    entries = F.array(
        *(F.struct(F.lit(i).alias("_measure"), _side(i).alias("_side"), F.col(f"_v{i}").alias("_value")) for i in range(len(measures)))
    )
    long = joined.select("_group", F.inline(entries)).filter(F.col("_value").isNotNull())
    inside = F.when(F.col("_side") == 0, F.col("_value"))
    counted = long.groupBy("_group", "_measure", "_side", inside.alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    return stored(counted, "median")


def _at_rank(entries: Column, rank: Column, value: str) -> Column:
    """``value`` of the first of the sorted (value, rows) that reaches the rank, and the rank left within it."""
    nothing = F.struct(F.lit(0).cast("long").alias("passed"), F.lit(None).cast("double").alias("found"), F.lit(None).cast("long").alias("left"))

    def step(state: Column, entry: Column) -> Column:
        upto = state["passed"] + entry["_rows"]
        reached = state["found"].isNull() & (upto >= rank)
        return F.struct(
            upto.alias("passed"),
            F.when(reached, entry[value].cast("double")).otherwise(state["found"]).alias("found"),
            F.when(reached, rank - state["passed"]).otherwise(state["left"]).alias("left"),
        )

    return F.aggregate(entries, nothing, step)


def _narrowed(candidates: DataFrame) -> DataFrame:
    """Of each key's values those in the cell that holds its rank, which is counted from there on.

    A cell has no more than its share of the different values and the sketch's error, so the values shrink by
    nearly ``CELLS`` each round. The cuts are stored: a sketch that is made again need not be the same.
    """
    shares = [i / CELLS for i in range(1, CELLS)]
    cuts = candidates.groupBy(*KEYS).agg(F.percentile_approx("_value", shares, CELLS * FINER).alias("_cuts"))
    cell = F.size(F.filter("_cuts", lambda cut: cut < F.col("_value"))).alias("_cell")
    placed = candidates.join(stored(cuts, "median"), list(KEYS)).select(*KEYS, "_rank", "_value", "_rows", cell)
    cells = placed.groupBy(*KEYS, "_rank", "_cell").agg(F.sum("_rows").alias("_rows"))
    by_key = cells.groupBy(*KEYS, "_rank").agg(F.sort_array(F.collect_list(F.struct("_cell", "_rows"))).alias("_cells"))
    at = _at_rank(F.col("_cells"), F.col("_rank"), "_cell")
    wanted = by_key.select(*KEYS, at.alias("_at")).select(*KEYS, F.col("_at.found").cast("int").alias("_cell"), F.col("_at.left").alias("_left"))
    return placed.join(wanted, [*KEYS, "_cell"]).select(*KEYS, F.col("_left").alias("_rank"), "_value", "_rows")


def _crowded(candidates: DataFrame) -> bool:
    """Whether some key has more different values than are gathered."""
    return not candidates.groupBy(*KEYS).count().filter(F.col("count") > MOST_VALUES).isEmpty()


def _medians(df: DataFrame, groups: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``_group`` and one column per measure, ``_median<i>``."""
    counts = _counts(df, groups, keys, measures)

    def rows(side: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, F.col("_rows"))), F.lit(0))

    totals = counts.groupBy("_group", "_measure").agg(F.sum("_rows").alias("_n"), rows(-1).alias("_below"), rows(0).alias("_inside"))
    # The two middle ranks; one and the same when the count is odd.
    ranks = F.array_distinct(F.array(*(F.floor((F.col("_n") + k) / 2).cast("long") for k in (1, 2))))
    wanted = totals.select("_group", "_measure", "_below", "_inside", F.posexplode(ranks).alias("_which", "_rank"))
    rank = F.col("_rank") - F.col("_below")
    outside = F.raise_error("median outside its bracket").cast("long")
    wanted = wanted.select("_group", "_measure", "_which", F.when(rank.between(1, F.col("_inside")), rank).otherwise(outside).alias("_rank"))
    candidates = counts.filter("_side = 0").drop("_side").join(wanted, ["_group", "_measure"])
    while _crowded(candidates):
        candidates = stored(_narrowed(candidates), "median")
    entries = F.sort_array(F.collect_list(F.struct("_value", "_rows")))
    found = (
        candidates.groupBy(*KEYS, "_rank")
        .agg(entries.alias("_entries"))
        .withColumn("_value", _at_rank(F.col("_entries"), F.col("_rank"), "_value")["found"])
    )
    by_measure = (F.avg(F.when(F.col("_measure") == i, F.col("_value"))).alias(f"_median{i}") for i in range(len(measures)))
    return found.groupBy("_group").agg(*by_measure)


def group_stats_with_median(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat]) -> DataFrame:
    """Like ``group_stats``, with exact medians among the statistics; missing and NaN are passed over.

    Two scans whatever the number of medians. At most ``MOST_VALUES`` values of a group are in one list, however
    its values are spread; a median outside its bracket would be an error, never a wrong value.
    """
    measures = list(dict.fromkeys(s.measure for s in stats if s.stat == "median"))
    groups = _first_pass(df, keys, [s for s in stats if s.stat != "median"], measures)
    found = groups.join(_medians(df, groups, keys, measures), "_group", "left")

    def column(s: Stat) -> Column:
        return F.col(f"_median{measures.index(s.measure)}" if s.stat == "median" else f"`{s.name}`").alias(s.name)

    return found.select(*(F.col(f"`{k}`") for k in keys), *(column(s) for s in stats))

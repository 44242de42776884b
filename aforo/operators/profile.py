"""Profile of a table: size, types, missing and invalid values, correlation, first rows.

Each profile is one pass over the table whatever the number of columns, and comes back in long
form: one row per column, rule or pair.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.functions.values import is_floating, missing, nan_to_null, number_from_text

#: Pairs of columns that one aggregate correlates. A pair has ten buffer fields, and generated code ends at a
#: hundred; methods that the virtual machine compiles end earlier.
PAIRS_PER_TILE = 3

# The readings the study counts as invalid.
INVALID_RULES: dict[str, str] = {"vmed_negativa": "vmed < 0"}


def _long(totals: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Unfold a one-row table into one row per entry."""
    entries = [F.struct(*(c.alias(n) for c, n in zip(row, names, strict=True))) for row in rows]
    return totals.select(F.inline(F.array(*entries)))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("filas")).select("filas", F.lit(len(df.columns)).alias("columnas"))


def dtype_profile(df: DataFrame) -> DataFrame:
    """Type and number of present values of each column."""
    totals = df.agg(*(F.count_if(~missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)))
    rows = [(F.lit(c), F.lit(t), F.col(f"_{i}")) for i, (c, t) in enumerate(df.dtypes)]
    return _long(totals, rows, ("columna", "tipo", "presentes"))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values (NULL or NaN) of each column."""
    totals = df.agg(*(F.count_if(missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)))
    return _long(totals, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(df.columns)], ("columna", "faltantes"))


def invalid_readings(df: DataFrame, rules: Mapping[str, str] = INVALID_RULES) -> DataFrame:
    """Rows that break each rule; a rule is an SQL condition and NULL does not break it."""
    totals = df.agg(*(F.count_if(F.expr(rule)).alias(f"_{i}") for i, rule in enumerate(rules.values())))
    return _long(totals, [(F.lit(name), F.col(f"_{i}")) for i, name in enumerate(rules)], ("regla", "filas"))


def _lost(text: Column, type_name: str) -> Column:
    filled = (F.trim(text) != "") & (F.lower(F.trim(text)) != "nan")
    return filled & number_from_text(text, type_name).isNull()


def cast_losses(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text cells that hold something, yet become NULL as the given type. ``NaN`` is missing, not lost."""
    names = [c for c in types if c in raw.columns]
    totals = raw.agg(*(F.count_if(_lost(F.col(f"`{c}`"), types[c])).alias(f"_{i}") for i, c in enumerate(names)))
    return _long(totals, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(names)], ("columna", "perdidos"))


def watch_losses(raw: DataFrame, types: Mapping[str, str], watch: Observation, dates: Mapping[str, Column] | None = None) -> DataFrame:
    """``raw`` itself; the first action over it also counts what ``cast_losses`` counts, in the same scan.

    ``dates`` maps a text column to the timestamp that is read from it: text that gives none is lost, too. After
    the action ``watch.get`` has the counts, unless there was no row: Spark then drops the plan with the watch in it.
    """
    lost = {c: _lost(F.col(f"`{c}`"), t) for c, t in types.items() if c in raw.columns}
    lost |= {c: F.col(f"`{c}`").isNotNull() & stamp.isNull() for c, stamp in (dates or {}).items()}
    return raw.observe(watch, *(F.count_if(condition).alias(c) for c, condition in lost.items()))


def seen_losses(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """``columna`` and ``perdidos`` from a finished watch's counts (``watch.get``), a row per column."""
    entries = [F.struct(F.lit(c).alias("columna"), F.lit(n).cast("long").alias("perdidos")) for c, n in counts.items()]
    return spark.range(1).select(F.inline(F.array(*entries)))


def classification_profile(classified: DataFrame) -> DataFrame:
    """Rows in all, inside a period, and outside; needs ``classify(..., keep_unclassified=True)``."""
    return classified.agg(
        F.count(F.lit(1)).alias("filas"),
        F.count("periodo_num").alias("clasificadas"),
        F.count_if(F.col("periodo_num").isNull()).alias("sin_periodo"),
    )


def unparsed_dates(df: DataFrame, fecha: str = "fecha", ts: str = "fecha_ts") -> DataFrame:
    """Rows whose date text is present but could not be read."""
    return df.agg(
        F.count(fecha).alias("con_fecha"),
        F.count_if(F.col(fecha).isNotNull() & F.col(ts).isNull()).alias("no_leidas"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair of numeric columns; 1 of a column with itself.

    A row counts for a pair when both values are present; NaN is missing. A column that is constant over a pair's
    rows gives NULL. An empty table has no pairs.

    The pairs, each of two columns once, are dealt into tiles of ``PAIRS_PER_TILE``, and a row goes once into each
    tile's moments: their buffers fit generated code whatever the number of columns, and the work grows
    with the pairs. One tile copies nothing. One scan; what is shuffled is a row per task and tile.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        raise ValueError("no numeric columns to correlate")

    def value(name: str) -> Column:
        column = F.col(f"`{name}`")
        present = nan_to_null(column) if is_floating(df.schema[name].dataType) else column
        return present.cast("double").alias(f"_{names.index(name)}")

    def both(i: int | None, j: int | None, slot: int) -> list[Column]:
        """The values of a pair, where both are present; NULL in the slots that a last tile has left."""
        if i is None:
            return [F.lit(None).cast("double").alias(f"_{side}{slot}") for side in "xy"]
        x, y = F.col(f"_{i}"), F.col(f"_{j}")
        return [F.when(y.isNotNull(), x).alias(f"_x{slot}"), F.when(x.isNotNull(), y).alias(f"_y{slot}")]

    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    slots = min(PAIRS_PER_TILE, len(pairs))
    tiles = [pairs[at : at + slots] for at in range(0, len(pairs), slots)]
    tiles[-1] = tiles[-1] + [(None, None)] * (slots - len(tiles[-1]))
    rows = [[F.lit(t).alias("_tile"), *(c for slot, pair in enumerate(tile) for c in both(*pair, slot))] for t, tile in enumerate(tiles)]
    values = df.select(*(value(n) for n in names))
    dealt = values.select(*rows[0]) if len(rows) == 1 else values.select(F.inline(F.array(*(F.struct(*r) for r in rows))))

    def pearson(slot: int) -> Column:
        x, y = F.col(f"_x{slot}"), F.col(f"_y{slot}")
        # ``corr`` itself divides by the deviations unguarded, which in ANSI mode fails the query.
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"_r{slot}")

    totals = dealt.groupBy("_tile").agg(*(pearson(slot) for slot in range(slots)))
    found = totals.select("_tile", F.posexplode(F.array(*(f"_r{slot}" for slot in range(slots)))).alias("_slot", "_r"))
    place = F.col("_tile") * slots + F.col("_slot")
    ends = [F.get(F.array(*(F.lit(names[pair[side]]) for pair in pairs)), place) for side in (0, 1)]
    named = found.filter(place < len(pairs)).select(ends[0].alias("_a"), ends[1].alias("_b"), "_r")
    same = F.col("_a") == F.col("_b")
    r = F.when(same & F.col("_r").isNotNull(), F.lit(1.0)).otherwise(F.col("_r")).alias("correlacion")
    there = F.struct(F.col("_a").alias("columna_a"), F.col("_b").alias("columna_b"), r)
    back = F.struct(F.col("_b").alias("columna_a"), F.col("_a").alias("columna_b"), r)
    return named.select(F.inline(F.when(same, F.array(there)).otherwise(F.array(there, back))))


def column_profile(df: DataFrame, rules: Mapping[str, str] = INVALID_RULES) -> DataFrame:
    """All of the above in one pass: size, and per column its type, present and missing values, per rule the rows."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)),
        *(F.count_if(F.expr(rule)).alias(f"_r{i}") for i, rule in enumerate(rules.values())),
    )
    nothing = F.lit(None).cast("string")
    rows = [(F.lit("tabla"), nothing, nothing, F.col("_rows"), F.lit(len(df.columns)).cast("long"))]
    rows += [(F.lit("columna"), F.lit(c), F.lit(t), F.col("_rows") - F.col(f"_{i}"), F.col(f"_{i}")) for i, (c, t) in enumerate(df.dtypes)]
    rows += [(F.lit("regla"), F.lit(r), nothing, F.col(f"_r{i}"), F.lit(None).cast("long")) for i, r in enumerate(rules)]
    return _long(totals, rows, ("clase", "nombre", "tipo", "filas", "otras"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order: each task keeps ``n``, nothing is sorted in full."""
    return df.orderBy(*order).limit(n)

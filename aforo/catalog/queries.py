"""The query catalogue: every operator and analysis over the readings views, by name.

``E`` is the view of ``events``, ``L`` that of ``lineitem``. Floating results are rounded to six
places so that they can be compared by value; integers that may be NULL come as doubles, as
they do in a data frame without nullable integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.functions.dates import day_type, weekday_number
from aforo.functions.values import is_floating, lookup
from aforo.operators import profile, reshape
from aforo.operators.classify import classify, classify_by_table
from aforo.operators.clean import clean
from aforo.operators.union import union_by_name
from aforo.periods import period_table, pick
from aforo.plans import analyses, charts, summary
from aforo.sources import lake, readings, sinks
from aforo.sources.scratch import scratch_path
from aforo.sources.views import EVENT_PERIODS, EVENTS_SCHEMA, LINEITEM_PERIODS, events_readings, lineitem_readings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ISO = "yyyy-MM-dd HH:mm:ss"
DAYFIRST = "dd/MM/yyyy HH:mm:ss"
RETURN_FLAGS = {"A": "a", "N": "n", "R": "r"}
READING = ("event_id", "id", "fecha_ts", "tipo_elem", "intensidad", "ocupacion", "carga", "vmed")
LABELS = ("periodo_num", "periodo")
# The view's integers, and two columns that the month files do not name.
VIEW_TYPES = {"event_id": "bigint", "id": "bigint", "intensidad": "int", "vmed": "int"}
RANGES = {"intensidad": (0, 900), "vmed": (0, 300)}
VALUE_RULES = {
    **profile.INVALID_RULES,
    "intensidad_negativa": "intensidad < 0",
    "ocupacion_fuera": "ocupacion < 0 OR ocupacion > 100",
    "carga_fuera": "carga < 0 OR carga > 100",
}


# Averages of two-decimal values often lie exactly half-way between two roundings (any group of 64
# rows may), where the order of summation would decide. The shift moves them off that point.
PLACES = 6
OFF_TIE = 1.37e-8


def rounded(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        return F.round(value + OFF_TIE, PLACES).alias(f.name) if is_floating(f.dataType) else value

    return df.select(*(column(f) for f in df.schema.fields))


def as_double(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("double"))


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def cleaned(spark: SparkSession, sf_dir: str, missing: str = "null", **options) -> DataFrame:
    return clean(events_readings(spark, sf_dir, missing), **options)


def classified(spark: SparkSession, sf_dir: str, period_end: str = "instant", only=None, **options) -> DataFrame:
    return classify(cleaned(spark, sf_dir, **options), EVENT_PERIODS, period_end, only=only)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(lineitem_readings(spark, sf_dir))


def lines_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(lines(spark, sf_dir), LINEITEM_PERIODS)


# Analyses by period.


@query
def period_stats(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir))


@query
def period_stats_day(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir, "day"))


@query
def period_stats_nan(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir, missing="nan", nan="propagate"))


@query
def period_stats_nan_skipped(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir, missing="nan", nan="skip"))


@query
def period_stats_rounded(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir), decimals=2)


@query
def period_stats_ranges(spark, sf_dir):
    return analyses.period_stats(classified(spark, sf_dir, ranges=RANGES))


@query
def load_by_hour(spark, sf_dir):
    return analyses.load_by_hour(classified(spark, sf_dir))


@query
def day_type_split(spark, sf_dir):
    return analyses.day_type_split(classified(spark, sf_dir))


@query
def day_type_split_fri_sat(spark, sf_dir):
    return analyses.day_type_split(classified(spark, sf_dir, weekend="fri_sat"))


@query
def road_type_split(spark, sf_dir):
    return analyses.road_type_split(classified(spark, sf_dir))


@query
def road_type_split_lines(spark, sf_dir):
    return analyses.road_type_split(lines_classified(spark, sf_dir))


@query
def rows_per_period(spark, sf_dir):
    return analyses.rows_per_period(classified(spark, sf_dir))


@query
def distinct_periods(spark, sf_dir):
    return analyses.distinct_periods(classified(spark, sf_dir))


@query
def hour_profile_one_period(spark, sf_dir):
    return analyses.hour_profile(classified(spark, sf_dir, only=[2]), "Primeros casos")


@query
def measure_stats_spec(spark, sf_dir):
    spec = {"intensidad": ["mean", "std", "max", "min", "count"], "carga": ["mean", "max"], "ocupacion": ["std", "min"]}
    return analyses.measure_stats(lines_classified(spark, sf_dir), ["periodo", "tipo_elem"], spec)


@query
def measure_median_spec(spark, sf_dir):
    spec = {"carga": ["median", "mean"], "ocupacion": ["median", "count"]}
    return analyses.measure_stats(classified(spark, sf_dir), ["periodo", "tipo_elem"], spec)


# The same analyses from the one-scan summary.


@query
def summary_period_stats(spark, sf_dir):
    return summary.period_stats(summary.summarize(classified(spark, sf_dir)))


@query
def summary_load_by_hour(spark, sf_dir):
    return summary.load_by_hour(summary.summarize(classified(spark, sf_dir)))


@query
def summary_day_type_split(spark, sf_dir):
    return summary.day_type_split(summary.summarize(classified(spark, sf_dir)))


@query
def summary_road_type_split(spark, sf_dir):
    return summary.road_type_split(summary.summarize(lines_classified(spark, sf_dir)))


@query
def summary_rows_per_period(spark, sf_dir):
    return summary.rows_per_period(summary.summarize(classified(spark, sf_dir)))


# Exploration by year and hour.


@query
def intensity_by_year(spark, sf_dir):
    return analyses.intensity_by_year(lines(spark, sf_dir))


@query
def median_approx_by_year(spark, sf_dir):
    """Whether the approximate median's rank lies within the sketch's error of the middle, by year."""
    df = lines(spark, sf_dir)
    found = analyses.intensity_by_year(df, approx=True).select(F.col("año").alias("_year"), F.col("mediana").alias("_median"))
    below = F.count_if(F.col("intensidad") < F.col("_median")) / F.count("intensidad")
    upto = F.count_if(F.col("intensidad") <= F.col("_median")) / F.count("intensidad")
    near = (below <= 0.501) & (upto >= 0.499)
    return df.join(found, F.col("año") == F.col("_year")).groupBy("año").agg(near.alias("cerca"))


@query
def intensity_by_hour(spark, sf_dir):
    return analyses.intensity_by_hour(cleaned(spark, sf_dir))


@query
def intensity_year_weekend(spark, sf_dir):
    return analyses.intensity_year_weekend(lines(spark, sf_dir))


# Cleaning and classification, row by row.


@query
def calendar_columns(spark, sf_dir):
    monday = weekday_number(F.col("fecha_ts"), "monday0").alias("día_semana_lunes")
    return cleaned(spark, sf_dir).select("event_id", "año", "mes", "día", "hora", "día_semana", monday)


@query
def weekend_sat_sun(spark, sf_dir):
    return cleaned(spark, sf_dir).select("event_id", "es_fin_semana", day_type(F.col("es_fin_semana")).alias("tipo_día"))


@query
def weekend_fri_sat(spark, sf_dir):
    df = cleaned(spark, sf_dir, weekend="fri_sat")
    return df.select("event_id", "es_fin_semana", day_type(F.col("es_fin_semana")).alias("tipo_día"))


@query
def classify_instant(spark, sf_dir):
    return classified(spark, sf_dir).select("event_id", *LABELS)


@query
def classify_day(spark, sf_dir):
    return classified(spark, sf_dir, "day").select("event_id", *LABELS)


@query
def classify_range_join(spark, sf_dir):
    df = classify_by_table(cleaned(spark, sf_dir), period_table(spark, EVENT_PERIODS))
    return as_double(df.select("event_id", *LABELS), "periodo_num")


@query
def classify_range_join_day(spark, sf_dir):
    df = classify_by_table(cleaned(spark, sf_dir), period_table(spark, EVENT_PERIODS), "day")
    return as_double(df.select("event_id", *LABELS), "periodo_num")


@query
def classify_range_join_broadcast(spark, sf_dir):
    df = classify_by_table(cleaned(spark, sf_dir), period_table(spark, EVENT_PERIODS), broadcast=True)
    return as_double(df.select("event_id", *LABELS), "periodo_num")


# Overlapping, inverted, half-open and far-off periods.
DIRTY_PERIODS = [
    (7, "solapado", "2024-01-05", "2024-01-12"),
    (3, "base", "2024-01-08", "2024-01-20"),
    (1, "invertido", "2024-01-25", "2024-01-02"),
    (2, "sin fin", "2024-01-01", None),
    (4, "sin inicio", None, "2024-01-31"),
    (5, "antiguo", "1800-01-01", "1801-12-31"),
    (6, "lejano", "9998-01-01", "9999-12-31"),
]


@query
def classify_range_join_dirty(spark, sf_dir):
    table = spark.createDataFrame(DIRTY_PERIODS, "num int, nombre string, inicio string, fin string")
    dated = table.withColumns({c: F.col(c).cast("date") for c in ("inicio", "fin")})
    return as_double(classify_by_table(cleaned(spark, sf_dir), dated).select("event_id", *LABELS), "periodo_num")


@query
def classify_range_join_many(spark, sf_dir):
    """Order lines by the orders' processing times: a period of a few days each, many of which overlap."""
    orders = spark.read.schema("o_orderkey bigint, o_orderpriority string, o_orderdate timestamp_ntz").parquet(f"{sf_dir}/orders.parquet")
    begin = F.col("o_orderdate").cast("date").alias("inicio")
    table = orders.select(F.col("o_orderkey").alias("num"), F.col("o_orderpriority").alias("nombre"), begin)
    table = table.withColumn("fin", F.date_add("inicio", (F.col("num") % 7).cast("int")))
    found = classify_by_table(lines(spark, sf_dir), table)
    return as_double(found.groupBy("fecha", *LABELS).agg(F.count(F.lit(1)).alias("filas")), "periodo_num")


@query
def map_lookup(spark, sf_dir):
    folders = {p.nombre: p.carpeta for p in EVENT_PERIODS}
    return classified(spark, sf_dir).select("event_id", lookup(F.col("periodo"), folders).alias("carpeta"))


@query
def parse_iso(spark, sf_dir):
    text = events_readings(spark, sf_dir).withColumn("fecha", F.date_format("fecha", ISO))
    return clean(text).select("event_id", "fecha", "fecha_ts")


@query
def parse_dayfirst(spark, sf_dir):
    text = events_readings(spark, sf_dir).withColumn("fecha", F.date_format("fecha", DAYFIRST))
    return clean(text, date_format="dayfirst").select("event_id", "fecha", "fecha_ts")


def mixed_dates(df: DataFrame) -> DataFrame:
    """Every third date as day-first text, the others as ISO."""
    return df.withColumn("fecha", F.when(F.col("event_id") % 3 == 0, F.date_format("fecha", DAYFIRST)).otherwise(F.date_format("fecha", ISO)))


@query
def parse_either(spark, sf_dir):
    return clean(mixed_dates(events_readings(spark, sf_dir)), date_format="either").select("event_id", "fecha", "fecha_ts")


@query
def unparsed_dates(spark, sf_dir):
    """A third of the dates is day-first text read as ISO: those are lost, and counted."""
    return profile.unparsed_dates(clean(mixed_dates(events_readings(spark, sf_dir))))


# Profiles.


@query
def table_profile(spark, sf_dir):
    return profile.table_profile(events_readings(spark, sf_dir))


@query
def dtype_profile(spark, sf_dir):
    return profile.dtype_profile(events_readings(spark, sf_dir))


@query
def null_profile(spark, sf_dir):
    return profile.null_profile(events_readings(spark, sf_dir))


@query
def null_profile_nan(spark, sf_dir):
    return profile.null_profile(events_readings(spark, sf_dir, "nan"))


@query
def invalid_readings(spark, sf_dir):
    return profile.invalid_readings(events_readings(spark, sf_dir), VALUE_RULES)


@query
def unclassified_rows(spark, sf_dir):
    df = classify(cleaned(spark, sf_dir), EVENT_PERIODS, keep_unclassified=True)
    return profile.classification_profile(df)


@query
def corr_matrix(spark, sf_dir):
    return profile.correlation(events_readings(spark, sf_dir))


@query
def corr_matrix_wide(spark, sf_dir):
    """Twelve columns, one of them constant."""
    df = events_readings(spark, sf_dir)
    extra = {f"x{i}": F.col("carga") * i + F.col("intensidad") % (i + 2) for i in range(1, 6)}
    return profile.correlation(df.withColumns(extra).withColumn("fijo", F.lit(1)))


@query
def profile_in_one_pass(spark, sf_dir):
    return profile.column_profile(events_readings(spark, sf_dir), VALUE_RULES)


@query
def head_rows(spark, sf_dir):
    return profile.first_rows(cleaned(spark, sf_dir), ["fecha_ts", "event_id"], 70).select(*READING)


# Union and reshaping.


@query
def union_periods(spark, sf_dir):
    df = events_readings(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    early = df.filter(F.col("fecha") < cut).select("tipo_elem", "carga", "event_id", "fecha")
    late = df.filter(F.col("fecha") >= cut).select("event_id", "fecha", "tipo_elem", "carga", "vmed")
    return as_double(union_by_name([early, late]), "vmed")


@query
def pivot_day_type(spark, sf_dir):
    return charts.day_type_bars(analyses.day_type_split(classified(spark, sf_dir)))


@query
def pivot_road_type(spark, sf_dir):
    return charts.road_type_bars(analyses.road_type_split(classified(spark, sf_dir)))


@query
def pivot_road_type_all(spark, sf_dir):
    """All event types as road types, one of them missing: a column for each."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") != "view", F.upper("event_type"))
    typed = cleaned(spark, sf_dir).drop("tipo_elem").join(events.select("event_id", kind.alias("tipo_elem")), "event_id")
    return charts.road_type_bars(analyses.road_type_split(classify(typed, EVENT_PERIODS)))


@query
def pivot_from_rows(spark, sf_dir):
    return reshape.mean_matrix(lines_classified(spark, sf_dir), "periodo", "tipo_elem", RETURN_FLAGS, charts.CHART_MEASURES)


@query
def pivot_from_rows_rest(spark, sf_dir):
    """Two road types by name, all others together."""
    listed = {k: v for k, v in RETURN_FLAGS.items() if k != "R"}
    return reshape.mean_matrix(lines_classified(spark, sf_dir), "periodo", "tipo_elem", listed, charts.CHART_MEASURES, rest="otros")


@query
def pivot_hour_period(spark, sf_dir):
    return charts.load_curves_wide(analyses.load_by_hour(classified(spark, sf_dir)), EVENT_PERIODS)


# Tables behind the charts.


@query
def chart_period_means(spark, sf_dir):
    return charts.period_means(analyses.period_stats(classified(spark, sf_dir)), EVENT_PERIODS)


@query
def chart_load_curves(spark, sf_dir):
    return charts.load_curves(analyses.load_by_hour(classified(spark, sf_dir)))


@query
def chart_hour_error_bars(spark, sf_dir):
    return charts.hour_error_bars(analyses.intensity_by_hour(cleaned(spark, sf_dir)))


@query
def chart_correlation(spark, sf_dir):
    return profile.correlation(lineitem_readings(spark, sf_dir))


# Files. The view is written once per session and scale as a tree of month files.


@cache
def month_tree(spark: SparkSession, sf_dir: str) -> str:
    """All readings as month files in period folders, each row in the folder of the last period begun.

    The second folder has its columns in another order. Dates are text to the second.
    """
    root = scratch_path(spark, "meses")
    df = events_readings(spark, sf_dir)
    starts = [F.lit(p.inicio.isoformat()).cast("timestamp_ntz") for p in EVENT_PERIODS]
    for i, period in enumerate(EVENT_PERIODS):
        rows = df
        if i > 0:
            rows = rows.filter(F.col("fecha") >= starts[i])
        if i + 1 < len(starts):
            rows = rows.filter(F.col("fecha") < starts[i + 1])
        columns = [F.date_format("fecha", ISO).alias("fecha") if c == "fecha" else F.col(c) for c in df.columns]
        text = rows.select(*(reversed(columns) if i == 1 else columns))
        sinks.write_csv(text, f"{root}/{period.carpeta}/{period.inicio:%m-%Y}.csv", sep=readings.SEPARATOR)
    return root


@query
def csv_all_folders(spark, sf_dir):
    return clean(readings.read_all(spark, month_tree(spark, sf_dir), types=VIEW_TYPES)).select(*READING)


@query
def csv_folder_label(spark, sf_dir):
    df = readings.read_folder(spark, month_tree(spark, sf_dir), EVENT_PERIODS[2], types=VIEW_TYPES)
    return clean(df).select(*READING, *LABELS)


@query
def csv_selected_periods(spark, sf_dir):
    df = readings.read_periods(spark, month_tree(spark, sf_dir), pick(EVENT_PERIODS, [1, 2, 4]), types=VIEW_TYPES)
    return clean(df).select(*READING, *LABELS)


@query
def csv_relabelled_by_date(spark, sf_dir):
    """Labels by folder, then by date: the date wins."""
    df = readings.read_periods(spark, month_tree(spark, sf_dir), EVENT_PERIODS, types=VIEW_TYPES)
    by_folder = clean(df).withColumn("periodo_carpeta", F.col("periodo_num"))
    both = classify(by_folder, EVENT_PERIODS, keep_unclassified=True)
    return as_double(both.select("event_id", "periodo_carpeta", *LABELS), "periodo_num")


@query
def csv_one_file(spark, sf_dir):
    path = f"{month_tree(spark, sf_dir)}/{EVENT_PERIODS[1].carpeta}/01-2024.csv"
    return clean(readings.read_files(spark, path, types=VIEW_TYPES)).select(*READING)


@query
def csv_inferred(spark, sf_dir):
    return clean(readings.read_all(spark, month_tree(spark, sf_dir), infer=True)).select(*READING)


@query
def csv_cast_losses(spark, sf_dir):
    """Fractional occupancies and loads read as integers."""
    raw = readings.read_text_cells(spark, f"{month_tree(spark, sf_dir)}/{readings.ALL_MONTHS}")
    return profile.cast_losses(raw, {"intensidad": "int", "ocupacion": "int", "carga": "int", "vmed": "double"})


@query
def csv_fractional_measures(spark, sf_dir):
    """Means by period over files with fractional cells, by the types of the month files: none is lost."""
    df = readings.read_all(spark, month_tree(spark, sf_dir))
    means = [F.avg(m).alias(f"{m}_mean") for m in ("intensidad", "ocupacion", "carga", "vmed")]
    return classify(clean(df), EVENT_PERIODS).groupBy("periodo").agg(*means)


@query
def csv_period_stats(spark, sf_dir):
    """The main job from files to result."""
    df = readings.read_all(spark, month_tree(spark, sf_dir), types=VIEW_TYPES)
    return analyses.period_stats(classify(clean(df), EVENT_PERIODS))


@query
def csv_sink_roundtrip(spark, sf_dir):
    result = analyses.period_stats(classified(spark, sf_dir))
    path = scratch_path(spark, "resultado")
    sinks.write_csv(result, path, keys=["periodo"])
    return spark.read.schema(result.schema).option("header", True).option("enforceSchema", False).csv(path)


@query
def parquet_by_month(spark, sf_dir):
    """Written partitioned by month, read back for two periods only."""
    path = scratch_path(spark, "lago")
    lake.write_readings(lines(spark, sf_dir), path)
    chosen = pick(LINEITEM_PERIODS, [2, 3])
    return analyses.road_type_split(classify(lake.read_readings(spark, path, chosen), chosen))


@query
def parquet_by_month_unbalanced(spark, sf_dir):
    """The same without the rebalancing shuffle."""
    path = scratch_path(spark, "lago")
    lake.write_readings(lines(spark, sf_dir), path, rebalance=False)
    chosen = pick(LINEITEM_PERIODS, [2, 3])
    return analyses.road_type_split(classify(lake.read_readings(spark, path, chosen), chosen))

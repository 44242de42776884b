"""The whole study as one batch job.

    spark-submit --py-files aforo.zip aforo/job.py DATA_ROOT OUTPUT [--periods 1 2 4] [--period-end day] ...

Reads the month files (or a Parquet copy written by ``--ingest``), cleans, classifies, and writes
the four analyses, the rows per period, the rows outside all periods and the tables behind the charts as CSV, all
from one scan of the readings. Cells and dates that could not be read are counted in ``perdidas`` by the same scan.
``--explore`` adds the exploration of the raw columns and of all readings, whatever their period.
The tables of a run replace those of the last one together: a run that fails leaves them as they were.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from aforo.functions.dates import CALENDAR_COLUMNS
from aforo.functions.values import number_from_text
from aforo.operators import profile
from aforo.operators.classify import classify
from aforo.operators.clean import TS, clean, timestamp_of
from aforo.periods import PERIODS, Period, pick, read_period_file
from aforo.plans import analyses, charts, summary
from aforo.sources import lake, readings, resultset, scratch, sinks

# Names of the result tables and their sort keys.
RESULTS = {
    "instancias_por_periodo": (summary.rows_per_period, ["periodo"]),
    "analisis_01_intensidad_ocupacion_carga": (summary.period_stats, ["periodo"]),
    "analisis_02_carga_por_hora": (summary.load_by_hour, ["periodo", "hora"]),
    "analisis_03_laborables_vs_finde": (summary.day_type_split, ["periodo", "tipo_día"]),
    "analisis_04_tipo_via": (summary.road_type_split, ["periodo", "tipo_elem"]),
}
CHARTS = {
    "grafico_01_intensidad_ocupacion_carga": (lambda s, p: charts.period_means(summary.period_stats(s), p), ["periodo_num"]),
    "grafico_02_carga_por_hora": (lambda s, p: charts.load_curves_wide(summary.load_by_hour(s), p), ["hora"]),
    "grafico_03_laborables_vs_finde": (lambda s, p: charts.day_type_bars(summary.day_type_split(s)), ["periodo"]),
    "grafico_04_tipo_via": (lambda s, p: charts.road_type_bars(summary.road_type_split(s)), ["periodo"]),
}
UNROUNDED = ("analisis_02_carga_por_hora",)
FIRST_ROWS = 5
# Where a Parquet copy keeps the losses of the text it was made from; readers of the copy pass over it.
LOSSES = "_perdidas"


@dataclass(frozen=True)
class Options:
    """The points on which sources disagree; the defaults are those of the README."""

    date_format: str = "iso"
    period_end: str = "instant"
    weekend: str = "sat_sun"
    weekday: str = "sunday1"
    nan: str = "skip"
    decimals: int | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def clean(self, df: DataFrame, **changes) -> DataFrame:
        given = {"date_format": self.date_format, "weekend": self.weekend, "weekday": self.weekday, "nan": self.nan, "ranges": self.ranges}
        return clean(df, **{**given, **changes})


def load_text(spark: SparkSession, root: str, nums: Sequence[int] | None, periods: Sequence[Period] = PERIODS) -> DataFrame:
    """Readings as text from all period folders, or from those of the given periods."""
    types = {c: "string" for c in readings.READING_TYPES}
    return readings.read_all(spark, root, types=types) if nums is None else readings.read_periods(spark, root, pick(periods, nums), types=types)


def watched(text: DataFrame, watch: Observation, options: Options) -> DataFrame:
    """The typed readings; the first action over them also counts the cells and dates that cannot be read."""
    numbers = {c: t for c, t in readings.READING_TYPES.items() if t != "string"}
    dates = {"fecha": timestamp_of(text, "fecha", options.date_format)}
    return readings.typed(profile.watch_losses(text, numbers, watch, dates))


def seen_counts(watch: Observation, written: DataFrame) -> dict[str, int]:
    """What was counted while ``written`` was; nothing where no row was read."""
    if written.isEmpty():
        return {c: 0 for c, t in readings.READING_TYPES.items() if t != "string"} | {"fecha": 0}
    return watch.get


def analyse(df: DataFrame, output: str, options: Options, periods: Sequence[Period] = PERIODS) -> None:
    """Write the results. The summary is stored first, a few hundred rows, and all results come from it."""
    spark = df.sparkSession
    by_date = classify(df, periods, options.period_end, keep_unclassified=True)
    sinks.write_parquet(summary.summarize(by_date), f"{output}/resumen")
    everything = spark.read.parquet(f"{output}/resumen")
    stored = everything.filter("periodo_num IS NOT NULL")
    outside = F.coalesce(F.sum(F.when(F.col("periodo_num").isNull(), F.col("filas"))), F.lit(0))
    total = F.coalesce(F.sum("filas"), F.lit(0))
    sinks.write_csv(everything.agg(total.alias("filas"), outside.alias("sin_periodo")), f"{output}/sin_periodo")
    for name, (build, keys) in RESULTS.items():
        decimals = None if name in UNROUNDED else options.decimals
        sinks.write_csv(build(stored), f"{output}/{name}", keys=keys, decimals=decimals)
    for name, (build, keys) in CHARTS.items():
        sinks.write_csv(build(stored, periods), f"{output}/{name}", keys=keys, decimals=options.decimals)


def explore(raw: DataFrame, df: DataFrame, output: str, options: Options) -> None:
    """Write the profile, correlation and first rows of the raw columns, and the intensity by year and hour.

    Six scans: one each for all profiles, the correlations, the first rows, hours and weekends, and two for the median.
    """
    spark = df.sparkSession

    def write(name: str, table: DataFrame, keys: Sequence[str] = ()) -> None:
        sinks.write_csv(table, f"{output}/exploracion_{name}", keys=keys, decimals=options.decimals)

    sinks.write_parquet(profile.column_profile(raw), f"{output}/perfil")
    found = spark.read.parquet(f"{output}/perfil")
    write("tamano", found.filter("clase = 'tabla'").select("filas", F.col("otras").alias("columnas")))
    columns = found.filter("clase = 'columna'")
    write("tipos", columns.select(F.col("nombre").alias("columna"), "tipo", F.col("filas").alias("presentes")), ["columna"])
    write("faltantes", columns.select(F.col("nombre").alias("columna"), F.col("otras").alias("faltantes")), ["columna"])
    write("lecturas_invalidas", found.filter("clase = 'regla'").select(F.col("nombre").alias("regla"), "filas"), ["regla"])
    numbered = raw.withColumn("id", number_from_text(F.col("id"), "bigint")) if dict(raw.dtypes).get("id") == "string" else raw
    write("correlacion", profile.correlation(numbered), ["columna_a", "columna_b"])
    order = ["fecha", *(c for c in raw.columns if c != "fecha")]
    sinks.write_csv(profile.first_rows(raw, order, FIRST_ROWS), f"{output}/exploracion_primeras_filas", keys=order)

    grain = ("año", "hora", "es_fin_semana", "_legible")
    legible = df.withColumn("_legible", F.col("fecha").isNull() | F.col(TS).isNotNull())
    sinks.write_parquet(summary.moments(legible, ("intensidad",), grain), f"{output}/resumen_exploracion")
    stored = spark.read.parquet(f"{output}/resumen_exploracion")
    unread = F.coalesce(F.sum(F.when(~F.col("_legible"), F.col("filas"))), F.lit(0))
    write("fechas_no_leidas", stored.agg(F.coalesce(F.sum("filas"), F.lit(0)).alias("filas"), unread.alias("no_leidas")))
    write("intensidad_por_anio", analyses.intensity_by_year(df), ["año"])
    by_hour = summary.intensity_by_hour(stored)
    write("intensidad_por_hora", by_hour, ["hora"])
    write("intensidad_por_anio_y_finde", summary.intensity_year_weekend(stored), ["año", "es_fin_semana"])
    write("grafico_intensidad_por_hora", charts.hour_error_bars(by_hour), ["hora"])


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Period analyses of sensor readings")
    parser.add_argument("root", help="folder of the period folders, or of a Parquet copy with --parquet")
    parser.add_argument("output")
    parser.add_argument("--periods", type=int, nargs="+", help="read only the folders of these periods (with --parquet: only their dates)")
    parser.add_argument("--period-file", help="CSV of num, nombre, inicio, fin and optionally carpeta instead of the known periods")
    parser.add_argument("--ingest", metavar="PATH", help="write the readings as Parquet by month and analyse that")
    parser.add_argument("--parquet", action="store_true", help="root is such a copy")
    parser.add_argument("--date-format", choices=("iso", "dayfirst", "either"), default="iso")
    parser.add_argument("--period-end", choices=("instant", "day"), default="instant")
    parser.add_argument("--weekend", choices=("sat_sun", "fri_sat"), default="sat_sun")
    parser.add_argument("--weekday", choices=("sunday1", "monday0"), default="sunday1")
    parser.add_argument("--nan", choices=("skip", "propagate"), default="skip")
    parser.add_argument("--ranges", nargs="+", metavar="COLUMN:LOW:HIGH", default=[], help="values outside become missing")
    parser.add_argument("--decimals", type=int)
    parser.add_argument("--explore", action="store_true", help="also write profiles, correlation, years and hours")
    return parser.parse_args(argv)


def _ranges(texts: Sequence[str]) -> dict[str, tuple[float, float]]:
    split = (text.rsplit(":", 2) for text in texts)
    return {column: (float(low), float(high)) for column, low, high in split}


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    options = Options(args.date_format, args.period_end, args.weekend, args.weekday, args.nan, args.decimals, _ranges(args.ranges))
    periods = read_period_file(spark, args.period_file) if args.period_file else PERIODS
    watch = Observation()
    if not args.parquet:
        # Before anything is written: a root without readings leaves old results alone.
        text = load_text(spark, args.root, args.periods, periods)
        raw, seen = readings.typed(text), watched(text, watch, options)
        if args.ingest:
            # The copy keeps NaN and all values, so that later runs can choose.
            lake.write_readings(replace(options, nan="propagate", ranges={}).clean(seen), args.ingest)
            counts = seen_counts(watch, lake.read_readings(spark, args.ingest))
            sinks.write_parquet(profile.seen_losses(spark, counts), f"{args.ingest}/{LOSSES}")
    copy = args.ingest or (args.root if args.parquet else None)
    if copy:
        chosen = pick(periods, args.periods) if args.parquet and args.periods else None
        kept = lake.read_readings(spark, copy, chosen, options.period_end)
        raw = kept.drop(TS, *CALENDAR_COLUMNS)
        df = seen = options.clean(kept, fecha=TS)
    else:
        df, seen = options.clean(raw), options.clean(seen)
    with resultset.replacing(spark, args.output) as output:
        analyse(seen, output, options, periods)
        if not copy:
            counts = seen_counts(watch, spark.read.parquet(f"{output}/resumen"))
            sinks.write_csv(profile.seen_losses(spark, counts), f"{output}/perdidas", keys=["columna"])
        elif readings.exists(spark, f"{copy}/{LOSSES}"):
            sinks.write_csv(spark.read.parquet(f"{copy}/{LOSSES}"), f"{output}/perdidas", keys=["columna"])
        if args.explore:
            explore(raw, df, output, options)
    scratch.release(spark)


def main(argv: Sequence[str] | None = None) -> None:
    spark = SparkSession.builder.appName("aforo").getOrCreate()
    try:
        run(spark, arguments(argv))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

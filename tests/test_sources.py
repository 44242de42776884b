import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aforo.functions import kinds
from aforo.operators import profile
from aforo.operators.classify import classify
from aforo.operators.clean import clean
from aforo.periods import PERIODS, Period
from aforo.plans import analyses
from aforo.sources import lake, readings, scratch, sinks

P1, P2, P3, P4 = PERIODS


@pytest.fixture
def root(tree):
    tree(P1.carpeta, "02-2019", ["1;2019-02-01 00:00:00;URB;100;5;10;40", "2;2019-02-01 00:15:00;M30;200;NaN;20;-1"])
    tree(P1.carpeta, "03-2019", ["URB;3;2019-03-01 00:00:00;300;;30"], "tipo_elem;id;fecha;intensidad;ocupacion;carga")
    tree(P2.carpeta, "03-2020", ["4;2020-03-20 00:00:00;URB;12.0;7;x;55", "5;basura;URB;-127;8;50;"])
    return tree.root


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_all_folders(spark, root):
    df = readings.read_all(spark, root)
    assert dict(df.dtypes) == {"id": "string", **readings.READING_TYPES}
    rows = {int(r.id): r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[3].tipo_elem == "URB" and rows[3].fecha == "2019-03-01 00:00:00"
    assert rows[3].vmed is None and rows[3].ocupacion is None
    assert rows[4].intensidad == 12 and rows[4].carga is None
    assert rows[2].vmed == -1 and rows[2].ocupacion != rows[2].ocupacion


def test_root_with_spaces_and_accents(spark, tmp_path):
    month = tmp_path / "datos de año 100%" / P1.carpeta / "02-2019.csv"
    month.parent.mkdir(parents=True)
    month.write_text("id;fecha\n7;2019-02-01 00:00:00\n")
    assert ids(readings.read_all(spark, str(tmp_path / "datos de año 100%"))) == [7]
    assert ids(readings.read_periods(spark, str(tmp_path / "datos de año 100%"), [P1])) == [7]


def test_quoted_cells_and_byte_order_mark(spark, tmp_path):
    month = tmp_path / P1.carpeta / "02-2019.csv"
    month.parent.mkdir(parents=True)
    month.write_text('"id";"fecha";"tipo_elem";"carga"\r\n8;"2019-02-01 00:00:00";"URB";"12"\r\n', encoding="utf-8-sig")
    row = readings.read_all(spark, str(tmp_path)).first()
    assert (row.id, row.fecha, row.tipo_elem, row.carga) == ("8", "2019-02-01 00:00:00", "URB", 12)


def test_lost_cells_are_counted(spark, root):
    raw = readings.read_text_cells(spark, f"{root}/{readings.ALL_MONTHS}")
    lost = {r.columna: r.perdidos for r in profile.cast_losses(raw, readings.READING_TYPES).collect()}
    assert lost == {"fecha": 0, "tipo_elem": 0, "intensidad": 0, "ocupacion": 0, "carga": 1, "vmed": 0}
    dates = profile.unparsed_dates(clean(readings.typed(raw))).first()
    assert tuple(dates) == (5, 1)


def test_one_scan_per_header(spark, root, plan):
    assert plan(readings.read_all(spark, root), "simple").count("FileScan csv") == 2


def test_folder_label(spark, root):
    df = readings.read_folder(spark, root, P2)
    assert {(r.periodo_num, r.periodo) for r in df.collect()} == {(2, "Primeros casos")}
    assert readings.read_folder(spark, root, Period(3, "x", P3.inicio, P3.fin)) is None
    assert readings.read_folder(spark, root, P4) is None


def test_selected_periods(spark, root, plan):
    assert ids(readings.read_periods(spark, root, [P1])) == [1, 2, 3]
    assert ids(readings.read_periods(spark, root, [P2, P4])) == [4, 5]
    assert P2.carpeta not in plan(readings.read_periods(spark, root, [P1]))
    by_date = classify(clean(readings.read_periods(spark, root, PERIODS)), keep_unclassified=True)
    assert {int(r.id): r.periodo_num for r in by_date.collect()} == {1: 1, 2: 1, 3: 1, 4: 3, 5: None}


def test_nothing_to_read_is_an_error(spark, tmp_path):
    """A mistyped root, or one without month files, must not pass as an empty table."""
    (tmp_path / P1.carpeta).mkdir()
    for root in (tmp_path, tmp_path / "no"):
        with pytest.raises(FileNotFoundError):
            readings.read_all(spark, str(root))
        with pytest.raises(FileNotFoundError):
            readings.read_periods(spark, str(root), PERIODS)


def test_one_empty_folder_among_others(spark, root):
    from pathlib import Path

    (Path(root) / P4.carpeta).mkdir()
    assert ids(readings.read_all(spark, root)) == [1, 2, 3, 4, 5]
    assert ids(readings.read_periods(spark, root)) == [1, 2, 3, 4, 5]


def test_root_with_pattern_characters(spark, tmp_path):
    month = tmp_path / "a[1]{b}*?" / P1.carpeta / "02-2019[x].csv"
    month.parent.mkdir(parents=True)
    month.write_text("id;fecha\n7;2019-02-01 00:00:00\n")
    other = tmp_path / "a1b" / P1.carpeta / "02-2019.csv"
    other.parent.mkdir(parents=True)
    other.write_text("id;fecha\n8;2019-02-01 00:00:00\n")
    root = str(tmp_path / "a[1]{b}*?")
    assert ids(readings.read_all(spark, root)) == [7]
    assert ids(readings.read_periods(spark, root, [P1])) == [7]


def test_many_months_take_few_jobs(spark, tmp_path):
    folder = tmp_path / P1.carpeta
    folder.mkdir()
    for i in range(200):
        (folder / f"{i:03}.csv").write_text(f"id;fecha\n{i};2019-02-01 00:00:00\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-months", "")
    df = readings.read_all(spark, str(tmp_path))
    assert len(tracker.getJobIdsForGroup("many-months")) < 5
    spark.sparkContext._jsc.clearJobGroup()
    assert df.count() == 200


def test_inference_ignores_the_session_zone(spark, tree):
    """02:15 does not exist that day in Madrid; it is still hour 2."""
    root = tree(P1.carpeta, "03-2019", ["1;2019-03-31 02:15:00;URB;100;5;10;40"])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        row = clean(readings.read_all(spark, root, infer=True)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row.hora, row.intensidad) == (2, 100)


def test_inference_over_unlike_files(spark, tree):
    tree(P1.carpeta, "02-2019", ["1;2019-02-01 00:00:00;URB;100;5;10;40"])
    root = tree(P1.carpeta, "03-2019", ["abc;2;2019-03-01 00:00:00;2.5"], "intensidad;id;fecha;carga")
    df = readings.read_all(spark, root, infer=True)
    types = dict(df.dtypes)
    assert types["intensidad"] == "string" and types["carga"] == "double" and types["id"] == "int"
    assert [(r.id, r.intensidad, r.carga) for r in df.orderBy("id").collect()] == [(1, "100", 10.0), (2, "abc", 2.5)]


def test_inference_takes_one_job_for_any_number_of_headers(spark, tree):
    """Seven orders of the columns, whose cells disagree between files; the types are those of all cells."""
    names = ["id", "fecha", "carga", "vmed"]
    for i in range(7):
        turned = names[i % 4 :] + names[: i % 4] + [f"x{i}"]
        cells = {"id": str(i), "fecha": "2019-02-01 00:00:00", "carga": "3000000000" if i == 5 else "1", "vmed": "2.5" if i == 6 else "7"}
        root = tree(P1.carpeta, f"{i:02}-2019", [";".join(cells.get(c, "true") for c in turned)], ";".join(turned))
    tracker = spark.sparkContext.statusTracker()
    text = readings.read_text_cells(spark, f"{root}/{readings.ALL_MONTHS}")
    spark.sparkContext.setJobGroup("inference", "")
    try:
        types = kinds.settled(text)
        stages = [s for j in tracker.getJobIdsForGroup("inference") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert types == {"id": "int", "fecha": "string", "carga": "bigint", "vmed": "double", **{f"x{i}": "boolean" for i in range(7)}}
    assert len(stages) <= 3
    df = readings.read_all(spark, root, infer=True)
    assert dict(df.dtypes) == types and df.agg(F.sum("id"), F.sum("carga"), F.sum("vmed")).first() == (21, 3000000006, 44.5)


@pytest.mark.parametrize(
    ("cells", "kind"),
    [
        (["1", None, "-2"], "int"),
        (["1", "2147483648"], "bigint"),
        (["1", "-9223372036854775809"], "decimal(38,0)"),
        (["1", "9" * 39], "double"),
        (["1", "2.5"], "double"),
        (["1", "NaN"], "double"),
        (["TRUE", "false", ""], "boolean"),
        (["2020-02-29", "2019-01-01"], "date"),
        (["2020-02-30"], "string"),
        (["2020-02-29", "2020-02-29 10:00:00"], "string"),
        (["true", "1"], "string"),
        (["1", "x"], "string"),
        (["", None], "string"),
        ([], "string"),
    ],
)
def test_kinds(spark, cells, kind):
    """The same whatever the order and the parts of the rows; reading by the kind loses no cell."""
    for rows in (cells, cells[::-1]):
        df = spark.createDataFrame([(c, "t") for c in rows], "`a.b` string, other string").repartition(3)
        assert kinds.settled(df)["a.b"] == kind
    read = kinds.as_kinds(df, {"a.b": kind})
    assert dict(read.dtypes) == {"a.b": kind, "other": "string"}
    assert read.filter("`a.b` IS NOT NULL").count() == sum(c is not None and (c != "" or kind == "string") for c in cells)


def test_fractional_and_large_cells_are_kept(spark, tree):
    root = tree(P1.carpeta, "02-2019", ["1;2019-02-01 00:00:00;URB;12.7;5;21.5;99999999999"])
    row = readings.read_all(spark, root).first()
    assert (row.intensidad, row.carga, row.vmed) == (12.7, 21.5, 99999999999.0)


def test_empty_and_header_only_files(spark, root):
    from pathlib import Path

    folder = Path(root) / P4.carpeta
    folder.mkdir()
    (folder / "06-2020.csv").write_text("")
    (folder / "07-2020.csv").write_text("id;fecha;tipo_elem;intensidad;ocupacion;carga;vmed\n")
    assert ids(readings.read_all(spark, root)) == [1, 2, 3, 4, 5]
    assert readings.read_periods(spark, root, [P4]).count() == 0
    (folder / "07-2020.csv").unlink()
    only_empty = readings.read_periods(spark, root, [P4])
    assert only_empty.count() == 0 and only_empty.columns[-2:] == ["periodo_num", "periodo"]
    assert analyses.period_stats(classify(clean(only_empty))).count() == 0


def test_one_file(spark, root):
    assert ids(readings.read_files(spark, f"{root}/{P1.carpeta}/03-2019.csv")) == [3]


def test_inferred_types(spark, root):
    df = readings.read_files(spark, f"{root}/{P1.carpeta}/02-2019.csv", infer=True)
    assert dict(df.dtypes)["ocupacion"] == "double" and dict(df.dtypes)["intensidad"] == "int"
    assert [r.hora for r in clean(df).orderBy("id").collect()] == [0, 0]
    both = readings.read_files(spark, f"{root}/{P1.carpeta}/*.csv", infer=True)
    assert [(r.id, r.intensidad, r.vmed) for r in both.orderBy("id").collect()] == [(1, 100, 40), (2, 200, -1), (3, 300, None)]


def test_part_file_with_another_order_is_refused(spark, tmp_path):
    month = tmp_path / P1.carpeta / "02-2019.csv"
    month.mkdir(parents=True)
    (month / "part-0.csv").write_text("fecha;tipo_elem;carga\n2019-02-01 00:00:00;URB;1\n")
    (month / "part-1.csv").write_text("tipo_elem;fecha;carga\nURB;2019-02-01 00:00:00;1\n")
    with pytest.raises((Py4JJavaError, PySparkException)):
        readings.read_all(spark, str(tmp_path)).collect()


def test_dayfirst_files(spark, tree):
    root = tree(P1.carpeta, "02-2019", ["1;28/02/2019 23:45:00;URB;1;1;1;1"])
    df = clean(readings.read_all(spark, root), date_format="dayfirst")
    assert tuple(df.select("mes", "día", "hora").first()) == (2, 28, 23)


def test_parquet_by_month(spark, root, tmp_path, plan):
    path = str(tmp_path / "lago")
    lake.write_readings(clean(readings.read_all(spark, root)), path)
    everything = lake.read_readings(spark, path)
    assert ids(everything) == [1, 2, 3, 4, 5]
    chosen = lake.read_readings(spark, path, [P3])
    assert ids(chosen) == [4]
    text = plan(chosen)
    assert "PartitionFilters: [isnotnull" in text or "PartitionFilters: [((" in text
    assert "GreaterThanOrEqual(fecha_ts,2020-03-16T00:00)" in text
    assert dict(everything.dtypes)["fecha_ts"] == "timestamp_ntz"


def test_month_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    """Nine tenths of the readings lie in one month."""
    minutes = F.expr("make_dt_interval(0, 0, cast(id % 40000 as int), 0)")
    fecha = F.when(F.col("id") % 10 > 0, F.lit("2020-03-01")).otherwise(F.lit("2020-07-01")).cast("timestamp_ntz") + minutes
    df = clean(spark.range(0, 200_000, 1, 8).select(fecha.alias("fecha"), F.sha2(F.col("id").cast("string"), 256).alias("t")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        lake.write_readings(df, str(tmp_path / "lago"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {m: len(list((tmp_path / "lago" / "año=2020" / f"mes={m}").glob("part-*"))) for m in (3, 7)}
    assert files[3] > 3 and files[7] <= 4
    assert spark.read.parquet(str(tmp_path / "lago")).count() == 200_000


def test_partition_pruning_reads_only_the_months(spark, root, tmp_path):
    path = str(tmp_path / "lago")
    lake.write_readings(clean(readings.read_all(spark, root)), path)
    chosen = lake.read_readings(spark, path, [P1])
    files = {r[0] for r in chosen.select(F.col("_metadata.file_path")).distinct().collect()}
    assert files and all("mes=2" in f or "mes=3" in f for f in files) and not any("2020" in f for f in files)


def test_result_is_one_sorted_file(spark, root, tmp_path):
    path = str(tmp_path / "resultado")
    df = classify(clean(readings.read_all(spark, root), nan="propagate"))
    sinks.write_csv(analyses.period_stats(df), path, keys=["periodo"])
    parts = sorted((tmp_path / "resultado").glob("part-*.csv"))
    assert len(parts) == 1
    lines = parts[0].read_text(encoding="utf-8").splitlines()
    assert lines[0].startswith("periodo,intensidad_mean,intensidad_std")
    assert [line.split(",")[0] for line in lines[1:]] == ["Confinamiento estricto", "Pre-pandemia"]
    # NaN and NULL are empty cells.
    assert "NaN" not in "".join(lines)


def test_rounded_result(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.125, 3)], "k string, v_mean double, n int")
    sinks.write_csv(df, str(tmp_path / "r"), keys=["k"], decimals=2)
    assert spark.read.csv(str(tmp_path / "r"), header=True).collect() == [("a", "0.12", "3")]
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()


def test_large_table_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    sinks.write_csv(df, str(tmp_path / "g"), keys=["id"])
    assert len(list((tmp_path / "g").glob("part-*.csv"))) > 1


def test_scratch_is_the_folder_the_session_names(spark, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch.scratch_path(spark, "x"), scratch.scratch_path(spark, "x")
    assert a.startswith(root) and a != b
    assert scratch.scratch_path(spark, "x", str(tmp_path)).startswith(str(tmp_path))


def test_scratch_reads_settings_and_writes_none():
    class Session:
        class sparkContext:
            applicationId = "none"

        class conf:
            settings = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"}

            @classmethod
            def get(cls, key, default=None):
                return cls.settings.get(key, default)

    assert scratch.scratch_path(Session, "x").startswith("hdfs://shared/warehouse/_scratch/aforo-x-")
    Session.conf.settings = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session, "x")


def test_scratch_is_cleaned(spark, tmp_path):
    table = scratch.stored(spark.range(3), "x", str(tmp_path))
    assert table.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert scratch.release(spark) >= 1
    assert list(tmp_path.iterdir()) == []

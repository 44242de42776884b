import random

import pytest
from pyspark.sql import functions as F

from aforo.catalog.queries import classified, cleaned, lines, lines_classified
from aforo.operators import profile, reshape
from aforo.operators.union import union_by_name
from aforo.plans import analyses, charts, summary

SF = "/root/testdata/sf0.001"
# The result columns.
CONTRACT = {
    "period_stats": "periodo intensidad_mean intensidad_std intensidad_max intensidad_min ocupacion_mean ocupacion_std "
    "ocupacion_max carga_mean carga_std carga_max",
    "load_by_hour": "periodo hora mean std",
    "day_type_split": "periodo tipo_día carga_mean carga_std intensidad_mean intensidad_std ocupacion_mean ocupacion_std",
    "road_type_split": "periodo tipo_elem carga_mean carga_std intensidad_mean intensidad_std ocupacion_mean ocupacion_std",
}


@pytest.fixture(scope="module")
def df(spark):
    return classified(spark, SF, "day")


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_order(df, name):
    result = getattr(analyses, name)(df)
    assert result.columns == CONTRACT[name].split()
    keys = [tuple(r)[: 1 if name == "period_stats" else 2] for r in result.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


@pytest.mark.parametrize("name", [*CONTRACT, "rows_per_period"])
def test_summary_gives_the_same(df, name):
    direct = getattr(analyses, name)(df).collect()
    merged = getattr(summary, name)(summary.summarize(df)).collect()
    assert len(direct) == len(merged)
    for a, b in zip(direct, merged):
        assert list(a.asDict()) == list(b.asDict())
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-10) if isinstance(x, float) else y)


def test_summary_of_groups_without_values(spark):
    rows = [("p", 1, 5, "L", "URB", 1.0, None), ("p", 1, 6, "L", "M30", 3.0, None), ("q", 2, 5, "L", "URB", 2.0, 4.0)]
    df = spark.createDataFrame(rows, "periodo string, periodo_num int, hora int, t string, tipo_elem string, carga double, ocupacion double")
    s = summary.summarize(df.withColumn("es_fin_semana", F.lit(False)), ("carga", "ocupacion"))
    got = [tuple(r) for r in summary.rollup(s, ["periodo"], summary.spec_stats({"carga": ["mean", "std"], "ocupacion": ["mean", "std", "max", "count"]})).collect()]
    assert got == [("p", 2.0, pytest.approx(2**0.5), None, None, None, 0), ("q", 2.0, None, 4.0, None, 4.0, 1)]


def test_median_cannot_be_merged(df):
    with pytest.raises(ValueError):
        summary.rollup(summary.summarize(df), ["periodo"], analyses.spec_stats({"carga": ["median"]}))


def test_parts_add_up(df):
    """The parts of each split weigh up to the whole."""
    total = {r.periodo: r["count"] for r in analyses.rows_per_period(df).collect()}
    assert sum(total.values()) == df.count()
    whole = {r.periodo: r.carga_mean for r in analyses.period_stats(df).collect()}
    for column, split in (("tipo_día", analyses.with_day_type(df)), ("tipo_elem", df)):
        sizes = split.groupBy("periodo", column).agg(F.count("carga").alias("n"), F.avg("carga").alias("m"))
        means = sizes.groupBy("periodo").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m")).collect()
        assert {r.periodo: pytest.approx(r.m) for r in means} == whole


def test_hour_profile(df):
    got = analyses.hour_profile(df, "Primeros casos").collect()
    assert [r.hora for r in got] == sorted(r.hora for r in got)
    assert {r.periodo for r in got} == {"Primeros casos"}


def test_rows_without_date_belong_to_no_year(spark):
    from aforo.operators.clean import clean

    raw = spark.createDataFrame([("basura", 1), ("2020-05-05 10:00:00", 4)], "fecha string, intensidad int")
    df = clean(raw)
    assert [tuple(r) for r in analyses.intensity_by_year(df).collect()] == [(2020, 4.0, 4.0, 4, 4, None, 1)]
    assert [tuple(r) for r in analyses.intensity_by_hour(df).collect()] == [(10, 4.0, None)]
    assert [tuple(r) for r in analyses.intensity_year_weekend(df).collect()] == [(2020, False, 4.0, None, 1)]


def test_approximate_year_median_is_close(spark):
    exact = analyses.intensity_by_year(lines(spark, SF)).collect()
    approx = analyses.intensity_by_year(lines(spark, SF), approx=True).collect()
    assert [r.mediana for r in approx] == pytest.approx([r.mediana for r in exact], rel=0.01)


def test_pivots(df):
    days = charts.day_type_bars(analyses.day_type_split(df))
    assert days.columns == ["periodo", "carga_fin_de_semana", "carga_laborable", "intensidad_fin_de_semana", "intensidad_laborable"]
    split = {(r.periodo, r["tipo_día"]): r for r in analyses.day_type_split(df).collect()}
    for r in days.collect():
        weekend = split.get((r.periodo, "Fin de semana"))
        assert r.carga_fin_de_semana == (pytest.approx(weekend.carga_mean) if weekend else None)
        assert r.intensidad_laborable == pytest.approx(split[r.periodo, "Laborable"].intensidad_mean)
    assert charts.road_type_bars(analyses.road_type_split(df)).columns[1:] == ["carga_m30", "carga_urb", "intensidad_m30", "intensidad_urb"]


def test_pivot_from_rows_equals_pivot_of_the_split(spark):
    df = lines_classified(spark, SF)
    values = reshape.categories(df, "tipo_elem")
    assert values == {"A": "a", "N": "n", "R": "r"}
    direct = reshape.mean_matrix(df, "periodo", "tipo_elem", values, ["carga"]).collect()
    via_split = charts.road_type_bars(analyses.road_type_split(df), values).select("periodo", "carga_a", "carga_n", "carga_r").collect()
    for a, b in zip(direct, via_split, strict=True):
        assert tuple(a) == pytest.approx(tuple(b))


def test_charts_from_the_summary(df):
    s = summary.summarize(df)
    for direct, merged in (
        (charts.period_means(analyses.period_stats(df)), charts.period_means(summary.period_stats(s))),
        (charts.load_curves_wide(analyses.load_by_hour(df)), charts.load_curves_wide(summary.load_by_hour(s))),
        (charts.day_type_bars(analyses.day_type_split(df)), charts.day_type_bars(summary.day_type_split(s))),
    ):
        assert direct.columns == merged.columns
        for a, b in zip(direct.collect(), merged.collect(), strict=True):
            assert [x if not isinstance(x, float) else pytest.approx(x, rel=1e-10) for x in a] == list(b)
    assert [r.periodo_num for r in charts.period_means(analyses.period_stats(df)).collect()] == [1, 2, 3, 4]


def test_too_many_categories_are_refused(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        assert len(reshape.categories(spark.range(3), "id")) == 3
        with pytest.raises(ValueError):
            reshape.categories(spark.range(4), "id")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_pivot_loses_no_category(spark):
    rows = [("p", "a", 1.0), ("p", "b", 2.0), ("p", "c", 4.0), ("p", None, 6.0), ("q", "a", None)]
    df = spark.createDataFrame(rows, "periodo string, tipo string, carga double")
    got = reshape.mean_matrix(df, "periodo", "tipo", {"a": "a", "b": "b"}, ["carga"], rest="otros").collect()
    assert [tuple(r) for r in got] == [("p", 1.0, 2.0, 5.0), ("q", None, None, None)]
    assert got[0].asDict().keys() == {"periodo", "carga_a", "carga_b", "carga_otros"}
    one = reshape.mean_matrix(df, "periodo", "tipo", {None: "nulo"}, ["carga", "carga"][:1], rest="otros").first()
    assert (one.carga_nulo, one.carga_otros) == (6.0, pytest.approx(7 / 3))
    all_listed = {"a": "a", "b": "b", "c": "c", None: "nulo"}
    assert reshape.mean_matrix(df, "periodo", "tipo", all_listed, ["carga"]).first().carga_nulo == 6.0
    for values in ({"a": "a", "b": "b", "c": "c"}, {"a": "a", "b": "b", None: "nulo"}):
        with pytest.raises(Exception, match="tipo has a category without a column"):
            reshape.mean_matrix(df, "periodo", "tipo", values, ["carga"]).collect()
    with pytest.raises(ValueError):
        reshape.mean_matrix(df, "periodo", "tipo", {"a": "otros"}, ["carga"], rest="otros")


def test_constant_column_has_no_correlation(spark):
    rows = [(1.0, 7, 2, None), (2.0, 7, 1, 5.0), (4.0, 7, 9, None)]
    df = spark.createDataFrame(rows, "a double, constante int, c int, solo double")
    got = {(r.columna_a, r.columna_b): r.correlacion for r in profile.correlation(df).collect()}
    expected = df.toPandas().corr()
    assert len(got) == 16
    for (a, b), value in got.items():
        assert value == (None if "constante" in (a, b) or "solo" in (a, b) else pytest.approx(expected.loc[a, b]))


def test_correlation_equals_that_of_a_data_frame(spark):
    df = lines(spark, SF).select("id", "intensidad", "ocupacion", "carga", "vmed")
    expected = df.toPandas().corr()
    for r in profile.correlation(df).collect():
        assert r.correlacion == pytest.approx(expected.loc[r.columna_a, r.columna_b], abs=1e-9)
        assert r.columna_a != r.columna_b or r.correlacion == 1.0


def test_error_bars(spark):
    for r in charts.hour_error_bars(analyses.intensity_by_hour(cleaned(spark, SF))).collect():
        assert r.superior - r.media == pytest.approx(r.desv_est)
        assert r.media - r.inferior == pytest.approx(r.desv_est)


def test_correlation_is_symmetric_and_pairwise(spark):
    rows = [(1.0, 2, None), (2.0, 4, 1.0), (3.0, 6, float("nan")), (4.0, 9, 3.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "a double, b int, c double").withColumn("texto", F.lit("x"))
    got = {(r.columna_a, r.columna_b): r.correlacion for r in profile.correlation(df).collect()}
    expected = df.drop("texto").replace(float("nan"), None).toPandas().corr()
    assert len(got) == 9
    for (a, b), value in got.items():
        assert value == pytest.approx(expected.loc[a, b])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 14])
def test_correlation_of_many_columns(spark, size):
    """Any number of tiles, the last one not full; NULL and NaN count pair by pair."""
    rnd = random.Random(size)
    rows = [[rnd.choice([rnd.gauss(i, 1 + i), rnd.gauss(i, 1), None, float("nan")]) for i in range(size)] for _ in range(60)]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} double" for i in range(size)))
    expected = df.toPandas().corr()
    got = [tuple(r) for r in profile.correlation(df).collect()]
    assert len(got) == len({r[:2] for r in got}) == size * size
    for a, b, value in got:
        assert value == pytest.approx(expected.loc[a, b], abs=1e-12) and (a != b or value == 1.0)
    assert profile.correlation(df.limit(0)).count() == 0


def test_correlation_stays_in_generated_code(spark, plan):
    """However many columns there are; rows are folded before the only shuffle."""
    df = spark.range(100).select(*((F.col("id") * i % 7).alias(f"c{i}") for i in range(30)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = plan(profile.correlation(df), "simple").splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    aggregates = [line for line in lines if "HashAggregate" in line]
    assert len(aggregates) == 2 and all("*(" in line for line in aggregates)
    assert sum("Exchange" in line for line in lines) == 1


def test_profiles(spark):
    rows = [(1, 2.0, -3), (None, float("nan"), 4), (5, None, None)]
    df = spark.createDataFrame(rows, "a int, b double, vmed int")
    assert tuple(profile.table_profile(df).first()) == (3, 3)
    assert {tuple(r) for r in profile.null_profile(df).collect()} == {("a", 1), ("b", 2), ("vmed", 1)}
    assert {tuple(r) for r in profile.dtype_profile(df).collect()} == {("a", "int", 2), ("b", "double", 1), ("vmed", "int", 2)}
    assert [tuple(r) for r in profile.invalid_readings(df).collect()] == [("vmed_negativa", 1)]


def test_first_rows(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (1, "a")], "n int, t string")
    assert [tuple(r) for r in profile.first_rows(df, ["n", "t"], 2).collect()] == [(1, "a"), (1, "b")]


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2, 9), ("y", 2, 9)], "t string, n int, v int")
    rows = sorted(tuple(r) for r in union_by_name([a, b, a]).select("n", "t", F.coalesce("v", F.lit(-1))).collect())
    assert rows == [(1, "x", -1), (1, "x", -1), (2, "y", 9), (2, "y", 9)]

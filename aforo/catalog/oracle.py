"""The catalogue's queries in plain SQL over the same tables, for comparison by value.

Where Spark has an integer and the SQL engine a big integer, the SQL casts; integers that may be
NULL are compared as doubles.
"""

from __future__ import annotations

from aforo.catalog.queries import DIRTY_PERIODS, OFF_TIE, PLACES, RANGES
from aforo.periods import Period
from aforo.sources.views import EVENT_PERIODS, LINEITEM_PERIODS

ORACLE: dict[str, str] = {}

CALENDAR = """
    CAST(year(fecha) AS INTEGER) AS "año", CAST(month(fecha) AS INTEGER) AS mes,
    CAST(day(fecha) AS INTEGER) AS "día", CAST(hour(fecha) AS INTEGER) AS hora,
    CAST(isodow(fecha) % 7 + 1 AS INTEGER) AS "día_semana",
    CAST(isodow(fecha) - 1 AS INTEGER) AS "día_semana_lunes"
"""


def _e(gap: str = "NULL", seconds: bool = False) -> str:
    fecha = "date_trunc('second', ts)" if seconds else "ts"
    return f"""
  E AS (
    SELECT event_id, user_id AS id, {fecha} AS fecha,
      CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'URB' ELSE 'M30' END AS tipo_elem,
      10 * CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS intensidad,
      CASE WHEN event_id % 7 = 0 THEN {gap} ELSE value / 5 END AS ocupacion,
      value AS carga, CAST(floor(value) AS INTEGER) - 20 AS vmed
    FROM events)"""


L = """
  E AS (
    SELECT l_suppkey AS id, l_shipdate AS fecha, l_returnflag AS tipo_elem, l_extendedprice AS intensidad,
      l_discount * 100 AS ocupacion, l_quantity AS carga, l_linenumber - 3 AS vmed
    FROM lineitem)"""


def _r(value: str) -> str:
    return f"round({value} + {OFF_TIE}, {PLACES})"


def _inside(p: Period, end: str) -> str:
    if end == "instant":
        return f"fecha >= TIMESTAMP '{p.inicio}' AND fecha <= TIMESTAMP '{p.fin}'"
    return f"fecha >= TIMESTAMP '{p.inicio}' AND fecha < TIMESTAMP '{p.fin}' + INTERVAL 1 DAY"


def _case(value: str, periods, end: str) -> str:
    whens = " ".join(
        f"WHEN {_inside(p, end)} THEN " + (f"{p.num}" if value == "num" else f"'{getattr(p, value)}'") for p in periods
    )
    return f"CASE {whens} END"


def _folder(value: str) -> str:
    """Label by the last period begun, as the month files are laid out."""
    whens = " ".join(
        f"WHEN fecha >= TIMESTAMP '{p.inicio}' THEN " + (f"{p.num}" if value == "num" else f"'{getattr(p, value)}'")
        for p in reversed(EVENT_PERIODS[1:])
    )
    first = EVENT_PERIODS[0]
    return f"CASE {whens} ELSE " + (f"{first.num}" if value == "num" else f"'{getattr(first, value)}'") + " END"


def _with(view: str, periods=EVENT_PERIODS, end: str = "instant", weekend: str = "6, 7", keep: bool = False) -> str:
    """Common tables: E the readings, C with calendar, P classified."""
    return f"""WITH {view},
  C AS (SELECT *, {CALENDAR}, isodow(fecha) IN ({weekend}) AS es_fin_semana FROM E),
  A AS (
    SELECT *, CASE WHEN es_fin_semana THEN 'Fin de semana' ELSE 'Laborable' END AS "tipo_día",
      CAST({_case("num", periods, end)} AS INTEGER) AS periodo_num, {_case("nombre", periods, end)} AS periodo
    FROM C),
  P AS (SELECT * FROM A {"" if keep else "WHERE periodo IS NOT NULL"})
"""


def _agg(measure: str, *stats: str, rounding=_r, names: dict[str, str] | None = None) -> str:
    sql = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min", "count": "count", "median": "median"}
    integer = measure in ("intensidad", "vmed")
    parts = []
    for s in stats:
        name = (names or {}).get(s, f"{measure}_{s}")
        call = f"{sql[s]}({measure})"
        exact = s == "count" or (integer and s in ("min", "max"))
        parts.append(f'{call if exact else rounding(call)} AS "{name}"')
    return ", ".join(parts)


def _period(rounding=_r) -> str:
    k = {"rounding": rounding}
    return ", ".join(
        (
            _agg("intensidad", "mean", "std", "max", "min", **k),
            _agg("ocupacion", "mean", "std", "max", **k),
            _agg("carga", "mean", "std", "max", **k),
        )
    )


SPLIT = ", ".join(_agg(m, "mean", "std") for m in ("carga", "intensidad", "ocupacion"))
E = _e()

BASE = _with(E)
ORACLE["period_stats"] = f"{BASE} SELECT periodo, {_period()} FROM P GROUP BY periodo"
ORACLE["summary_period_stats"] = ORACLE["period_stats"]
ORACLE["csv_sink_roundtrip"] = ORACLE["period_stats"]
ORACLE["period_stats_nan_skipped"] = ORACLE["period_stats"]
ORACLE["period_stats_day"] = f"{_with(E, end='day')} SELECT periodo, {_period()} FROM P GROUP BY periodo"
ORACLE["period_stats_nan"] = (
    f"{_with(_e(chr(39) + 'NaN' + chr(39) + '::DOUBLE'))} SELECT periodo, {_period()} FROM P GROUP BY periodo"
)
ORACLE["period_stats_rounded"] = f"{BASE} SELECT periodo, {_period(lambda value: f'round_even({value}, 2)')} FROM P GROUP BY periodo"
_valid = ", ".join(f"CASE WHEN {m} BETWEEN {a} AND {b} THEN {m} END AS {m}" for m, (a, b) in RANGES.items())
ORACLE["period_stats_ranges"] = (
    f"{BASE}, V AS (SELECT * EXCLUDE ({', '.join(RANGES)}), {_valid} FROM P) SELECT periodo, {_period()} FROM V GROUP BY periodo"
)
ORACLE["csv_period_stats"] = f"{_with(_e(seconds=True))} SELECT periodo, {_period()} FROM P GROUP BY periodo"

HOUR = _agg("carga", "mean", "std", names={"mean": "mean", "std": "std"})
ORACLE["load_by_hour"] = f"{BASE} SELECT periodo, hora, {HOUR} FROM P GROUP BY periodo, hora"
ORACLE["summary_load_by_hour"] = ORACLE["load_by_hour"]
ORACLE["hour_profile_one_period"] = (
    f"{BASE} SELECT periodo, hora, {HOUR} FROM P WHERE periodo = 'Primeros casos' GROUP BY periodo, hora"
)
ORACLE["chart_load_curves"] = f"{BASE} SELECT periodo, hora, {_r('avg(carga)')} AS mean FROM P GROUP BY periodo, hora"

ORACLE["day_type_split"] = f'{BASE} SELECT periodo, "tipo_día", {SPLIT} FROM P GROUP BY periodo, "tipo_día"'
ORACLE["summary_day_type_split"] = ORACLE["day_type_split"]
ORACLE["day_type_split_fri_sat"] = (
    f'{_with(E, weekend="5, 6")} SELECT periodo, "tipo_día", {SPLIT} FROM P GROUP BY periodo, "tipo_día"'
)
ORACLE["road_type_split"] = f"{BASE} SELECT periodo, tipo_elem, {SPLIT} FROM P GROUP BY periodo, tipo_elem"

LINES = _with(L, LINEITEM_PERIODS)
ORACLE["road_type_split_lines"] = f"{LINES} SELECT periodo, tipo_elem, {SPLIT} FROM P GROUP BY periodo, tipo_elem"
ORACLE["summary_road_type_split"] = ORACLE["road_type_split_lines"]
ORACLE["parquet_by_month"] = (
    f"{LINES} SELECT periodo, tipo_elem, {SPLIT} FROM P WHERE periodo_num IN (2, 3) GROUP BY periodo, tipo_elem"
)

ORACLE["rows_per_period"] = f"{BASE} SELECT periodo, count(*) AS count FROM P GROUP BY periodo"
ORACLE["summary_rows_per_period"] = ORACLE["rows_per_period"]
ORACLE["distinct_periods"] = f"{BASE} SELECT DISTINCT periodo FROM P"

ORACLE["measure_stats_spec"] = f"""{LINES}
SELECT periodo, tipo_elem, {_agg("intensidad", "mean", "std", "max", "min", "count")},
  {_agg("carga", "mean", "max")}, {_agg("ocupacion", "std", "min")}
FROM P GROUP BY periodo, tipo_elem"""
ORACLE["measure_median_spec"] = f"""{BASE}
SELECT periodo, tipo_elem, {_agg("carga", "median", "mean")}, {_agg("ocupacion", "median", "count")}
FROM P GROUP BY periodo, tipo_elem"""

YEAR = _agg(
    "intensidad",
    *("mean", "median", "max", "min", "std", "count"),
    names={"mean": "media", "median": "mediana", "max": "máximo", "min": "mínimo", "std": "desv_est", "count": "contador"},
)
CLOCK = _agg("intensidad", "mean", "std", names={"mean": "media", "std": "desv_est"})
ORACLE["intensity_by_year"] = f'{LINES} SELECT "año", {YEAR} FROM C GROUP BY "año"'
ORACLE["intensity_by_hour"] = f"{BASE} SELECT hora, {CLOCK} FROM C GROUP BY hora"
ORACLE["intensity_year_weekend"] = (
    f'{LINES} SELECT "año", es_fin_semana, {CLOCK}, count(intensidad) AS n_registros FROM C GROUP BY "año", es_fin_semana'
)
ORACLE["chart_hour_error_bars"] = f"""{BASE}, H AS (SELECT hora, avg(intensidad) AS m, stddev_samp(intensidad) AS s FROM C GROUP BY hora)
SELECT hora, {_r('m')} AS media, {_r('s')} AS desv_est, {_r('m - s')} AS inferior, {_r('m + s')} AS superior FROM H"""
ORACLE["chart_period_means"] = f"""{BASE}
SELECT periodo_num, periodo, {_agg("intensidad", "mean")}, {_agg("ocupacion", "mean")}, {_agg("carga", "mean")}
FROM P GROUP BY periodo_num, periodo"""

ORACLE["calendar_columns"] = f'{BASE} SELECT event_id, "año", mes, "día", hora, "día_semana", "día_semana_lunes" FROM C'
ORACLE["weekend_sat_sun"] = f'{BASE} SELECT event_id, es_fin_semana, "tipo_día" FROM A'
ORACLE["weekend_fri_sat"] = f'{_with(E, weekend="5, 6")} SELECT event_id, es_fin_semana, "tipo_día" FROM A'
ORACLE["classify_instant"] = f"{BASE} SELECT event_id, periodo_num, periodo FROM P"
ORACLE["classify_day"] = f"{_with(E, end='day')} SELECT event_id, periodo_num, periodo FROM P"


def _range_join(end: str) -> str:
    rows = ", ".join(f"({p.num}, '{p.nombre}', TIMESTAMP '{p.inicio}', TIMESTAMP '{p.fin}')" for p in EVENT_PERIODS)
    upper = "fecha <= fin" if end == "instant" else "fecha < fin + INTERVAL 1 DAY"
    return f"""WITH {E}, T(num, nombre, inicio, fin) AS (VALUES {rows})
SELECT event_id, CAST(num AS DOUBLE) AS periodo_num, nombre AS periodo
FROM E LEFT JOIN T ON fecha >= inicio AND {upper}"""


ORACLE["classify_range_join"] = _range_join("instant")
ORACLE["classify_range_join_day"] = _range_join("day")
ORACLE["classify_range_join_broadcast"] = ORACLE["classify_range_join"]


def _dirty() -> str:
    def day(text: str | None) -> str:
        return "NULL::TIMESTAMP" if text is None else f"TIMESTAMP '{text}'"

    rows = ", ".join(f"({n}, '{name}', {day(a)}, {day(b)})" for n, name, a, b in DIRTY_PERIODS)
    return f"""WITH {E}, T(num, nombre, inicio, fin) AS (VALUES {rows}),
  R AS (SELECT event_id, num, nombre, row_number() OVER (PARTITION BY event_id ORDER BY num) AS k
    FROM E LEFT JOIN T ON fecha >= inicio AND fecha <= fin)
SELECT event_id, CAST(num AS DOUBLE) AS periodo_num, nombre AS periodo FROM R WHERE k = 1"""


ORACLE["classify_range_join_dirty"] = _dirty()
ORACLE["classify_range_join_many"] = f"""WITH {L}, D AS (
    SELECT fecha, count(*) AS filas FROM E GROUP BY fecha
  ), T AS (
    SELECT o_orderkey AS num, o_orderpriority AS nombre, CAST(o_orderdate AS DATE) AS inicio,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS fin
    FROM orders
  ), F AS (
    SELECT D.fecha, min(num) AS num FROM D JOIN T ON fecha >= CAST(inicio AS TIMESTAMP) AND fecha <= CAST(fin AS TIMESTAMP) GROUP BY D.fecha
  )
SELECT D.fecha, CAST(F.num AS DOUBLE) AS periodo_num, T.nombre AS periodo, filas
FROM D LEFT JOIN F ON F.fecha = D.fecha LEFT JOIN T ON T.num = F.num"""
_folders = " ".join(f"WHEN '{p.nombre}' THEN '{p.carpeta}'" for p in EVENT_PERIODS)
ORACLE["map_lookup"] = f"{BASE} SELECT event_id, CASE periodo {_folders} END AS carpeta FROM P"


def _text(layout: str) -> str:
    return f"""WITH {E}, X AS (SELECT event_id, strftime(fecha, '{layout}') AS fecha FROM E)
SELECT event_id, fecha, try_strptime(fecha, '{layout}') AS fecha_ts FROM X"""


ORACLE["parse_iso"] = _text("%Y-%m-%d %H:%M:%S")
ORACLE["parse_dayfirst"] = _text("%d/%m/%Y %H:%M:%S")
MIXED = """CASE WHEN event_id % 3 = 0 THEN strftime(fecha, '%d/%m/%Y %H:%M:%S') ELSE strftime(fecha, '%Y-%m-%d %H:%M:%S') END"""
ORACLE["parse_either"] = f"WITH {_e(seconds=True)} SELECT event_id, {MIXED} AS fecha, fecha AS fecha_ts FROM E"
ORACLE["unparsed_dates"] = f"""WITH {E}, X AS (SELECT {MIXED} AS fecha FROM E)
SELECT count(fecha) AS con_fecha, count(*) FILTER (WHERE try_strptime(fecha, '%Y-%m-%d %H:%M:%S') IS NULL) AS no_leidas FROM X"""

VIEW_COLUMNS = ("event_id", "id", "fecha", "tipo_elem", "intensidad", "ocupacion", "carga", "vmed")
ORACLE["table_profile"] = f"WITH {E} SELECT count(*) AS filas, CAST({len(VIEW_COLUMNS)} AS INTEGER) AS columnas FROM E"


def _per_column(select: str, view: str = E) -> str:
    return f"WITH {view} " + " UNION ALL ".join(f"SELECT '{c}' AS columna, {select.format(c=c)} FROM E" for c in VIEW_COLUMNS)


_types = "CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS tipo"
ORACLE["dtype_profile"] = _per_column(f"{_types}, count({{c}}) AS presentes")
ORACLE["null_profile"] = _per_column("count(*) - count({c}) AS faltantes")
ORACLE["null_profile_nan"] = ORACLE["null_profile"]
RULES = {
    "vmed_negativa": "vmed < 0",
    "intensidad_negativa": "intensidad < 0",
    "ocupacion_fuera": "ocupacion < 0 OR ocupacion > 100",
    "carga_fuera": "carga < 0 OR carga > 100",
}
ORACLE["invalid_readings"] = f"WITH {E} " + " UNION ALL ".join(
    f"SELECT '{name}' AS regla, count(*) FILTER (WHERE {rule}) AS filas FROM E" for name, rule in RULES.items()
)
ORACLE["unclassified_rows"] = f"""{_with(E, keep=True)}
SELECT count(*) AS filas, count(periodo_num) AS clasificadas, count(*) - count(periodo_num) AS sin_periodo FROM P"""


ORACLE["profile_in_one_pass"] = (
    f"WITH {E} SELECT 'tabla' AS clase, NULL::VARCHAR AS nombre, NULL::VARCHAR AS tipo, count(*) AS filas, "
    f"CAST({len(VIEW_COLUMNS)} AS BIGINT) AS otras FROM E"
    + "".join(f" UNION ALL SELECT 'columna', '{c}', {_types.format(c=c).removesuffix(' AS tipo')}, count({c}), count(*) - count({c}) FROM E" for c in VIEW_COLUMNS)
    + "".join(f" UNION ALL SELECT 'regla', '{name}', NULL, count(*) FILTER (WHERE {rule}), NULL FROM E" for name, rule in RULES.items())
)


def _correlation(view: str, columns: tuple[str, ...]) -> str:
    return f"WITH {view} " + " UNION ALL ".join(
        f"SELECT '{a}' AS columna_a, '{b}' AS columna_b, {_r(f'corr({a}, {b})')} AS correlacion FROM E"
        for a in columns
        for b in columns
    )


ORACLE["corr_matrix"] = _correlation(E, ("event_id", "id", "intensidad", "ocupacion", "carga", "vmed"))
ORACLE["chart_correlation"] = _correlation(L, ("id", "intensidad", "ocupacion", "carga", "vmed"))

_wide = ", ".join(f"carga * {i} + intensidad % {i + 2} AS x{i}" for i in range(1, 6))
ORACLE["corr_matrix_wide"] = _correlation(
    E.replace("E AS (", "B AS (", 1) + f", E AS (SELECT *, {_wide}, 1 AS fijo FROM B)",
    ("event_id", "id", "intensidad", "ocupacion", "carga", "vmed", *(f"x{i}" for i in range(1, 6)), "fijo"),
)

READING = f"event_id, id, fecha AS fecha_ts, tipo_elem, intensidad, {_r('ocupacion')} AS ocupacion, {_r('carga')} AS carga, vmed"
ORACLE["head_rows"] = f"WITH {E} SELECT {READING} FROM E ORDER BY fecha, event_id LIMIT 70"
ORACLE["union_periods"] = f"""WITH {E}
SELECT tipo_elem, {_r('carga')} AS carga, event_id, fecha FROM E WHERE fecha < TIMESTAMP '2024-01-16'
UNION ALL BY NAME
SELECT event_id, fecha, tipo_elem, {_r('carga')} AS carga, CAST(vmed AS DOUBLE) AS vmed FROM E WHERE fecha >= TIMESTAMP '2024-01-16'"""


def _cells(column: str, values: dict[str, str], measures: tuple[str, ...]) -> str:
    return ", ".join(
        f"""{_r(f"avg({m}) FILTER (WHERE {column} = '{v}')")} AS {m}_{alias}""" for m in measures for v, alias in values.items()
    )


BARS = ("carga", "intensidad")
DAYS = {"Fin de semana": "fin_de_semana", "Laborable": "laborable"}
ORACLE["pivot_day_type"] = f"{BASE} SELECT periodo, {_cells(chr(34) + 'tipo_día' + chr(34), DAYS, BARS)} FROM P GROUP BY periodo"
ORACLE["pivot_road_type"] = f"{BASE} SELECT periodo, {_cells('tipo_elem', {'M30': 'm30', 'URB': 'urb'}, BARS)} FROM P GROUP BY periodo"
_kinds = {k.upper(): k for k in ("click", "error", "purchase", "signup")}
ORACLE["pivot_road_type_all"] = f"""{BASE}, K AS (
  SELECT P.* EXCLUDE tipo_elem, CASE WHEN event_type <> 'view' THEN upper(event_type) END AS tipo_elem FROM P JOIN events USING (event_id))
SELECT periodo, {_cells('tipo_elem', _kinds, BARS)},
  {", ".join(f"{_r(f'avg({m}) FILTER (WHERE tipo_elem IS NULL)')} AS {m}_nulo" for m in BARS)}
FROM K GROUP BY periodo"""
ORACLE["pivot_from_rows"] = f"{LINES} SELECT periodo, {_cells('tipo_elem', {'A': 'a', 'N': 'n', 'R': 'r'}, BARS)} FROM P GROUP BY periodo"
_others = "tipo_elem IS NULL OR tipo_elem NOT IN ('A', 'N')"
_rest = ", ".join(f"""{_r(f"avg({m}) FILTER (WHERE {_others})")} AS {m}_otros""" for m in BARS)
ORACLE["pivot_from_rows_rest"] = (
    f"{LINES} SELECT periodo, {_cells('tipo_elem', {'A': 'a', 'N': 'n'}, BARS)}, {_rest} FROM P GROUP BY periodo"
)
_names = {p.nombre: f"periodo_{p.num}" for p in EVENT_PERIODS}
ORACLE["pivot_hour_period"] = f"{BASE} SELECT hora, {_cells('periodo', _names, ('carga',))} FROM P GROUP BY hora"

FILES = _e(seconds=True)
FOLDER = f"CAST({_folder('num')} AS INTEGER) AS periodo_num, {_folder('nombre')} AS periodo"
ORACLE["csv_all_folders"] = f"WITH {FILES} SELECT {READING} FROM E"
ORACLE["csv_folder_label"] = f"WITH {FILES}, F AS (SELECT *, {FOLDER} FROM E) SELECT {READING}, periodo_num, periodo FROM F WHERE periodo_num = 3"
ORACLE["csv_selected_periods"] = (
    f"WITH {FILES}, F AS (SELECT *, {FOLDER} FROM E) SELECT {READING}, periodo_num, periodo FROM F WHERE periodo_num IN (1, 2, 4)"
)
ORACLE["csv_one_file"] = f"WITH {FILES}, F AS (SELECT *, {FOLDER} FROM E) SELECT {READING} FROM F WHERE periodo_num = 2"
_inferred = READING.replace("event_id, id", "CAST(event_id AS INTEGER) AS event_id, CAST(id AS INTEGER) AS id")
ORACLE["csv_inferred"] = f"WITH {FILES} SELECT {_inferred} FROM E"
ORACLE["csv_relabelled_by_date"] = f"""{_with(FILES, keep=True)}
SELECT event_id, CAST({_folder('num')} AS INTEGER) AS periodo_carpeta, CAST(periodo_num AS DOUBLE) AS periodo_num, periodo FROM P"""
ORACLE["csv_cast_losses"] = f"""WITH {FILES}
SELECT 'intensidad' AS columna, count(*) FILTER (WHERE intensidad <> floor(intensidad)) AS perdidos FROM E
UNION ALL SELECT 'ocupacion', count(*) FILTER (WHERE ocupacion <> floor(ocupacion)) FROM E
UNION ALL SELECT 'carga', count(*) FILTER (WHERE carga <> floor(carga)) FROM E
UNION ALL SELECT 'vmed', count(*) FILTER (WHERE false) FROM E"""
_means = ", ".join(_agg(m, "mean") for m in ("intensidad", "ocupacion", "carga", "vmed"))
ORACLE["csv_fractional_measures"] = f"{_with(FILES)} SELECT periodo, {_means} FROM P GROUP BY periodo"
ORACLE["parquet_by_month_unbalanced"] = ORACLE["parquet_by_month"]
ORACLE["median_approx_by_year"] = f'{LINES} SELECT "año", true AS cerca FROM C GROUP BY "año"'

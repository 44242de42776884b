"""Readings from delimited text: folders of month files, bound to columns by name.

Nothing is inferred from the data unless asked for. Cells are read as text and cast without raising, so
that a malformed cell is a NULL that ``operators.profile.cast_losses`` can count.
"""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.functions import kinds
from aforo.functions.values import number_from_text
from aforo.operators.union import union_by_name
from aforo.periods import PERIODS, Period

log = logging.getLogger(__name__)

# Separator, folder pattern and the named columns of the month files with their types.
SEPARATOR = ";"
ALL_MONTHS = "periodo_*/*.csv"
FOLDER_MONTHS = "*.csv"
# Waiting for storage, not work of the driver: one line of each month.
HEADERS_AT_ONCE = 16
# Measures are doubles: whole files hold integers, single cells may not.
READING_TYPES: dict[str, str] = {
    "fecha": "string",
    "tipo_elem": "string",
    "intensidad": "double",
    "ocupacion": "double",
    "carga": "double",
    "vmed": "double",
}


def literal_path(path: str) -> str:
    """The path with characters that file patterns give a meaning to taken as themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _file_system(spark, path)
    return files.exists(hadoop_path)


def month_files(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Month files under a file pattern, each with one file to take its header from; empty when there are none.

    A month is a plain file or, when Spark wrote it, a folder called ``*.csv`` of part files. Empty files
    hold no header and are passed over. The driver lists folders, on any file system Spark can read; no job runs.
    """
    glob, files = _file_system(spark, pattern)
    months: dict[str, str] = {}
    for status in files.globStatus(glob) or []:
        month = status.getPath().toString()
        leaves = [status]
        if status.isDirectory():
            leaves = [f for f in files.listStatus(status.getPath()) if f.isFile() and f.getPath().getName()[0] not in "_."]
        leaves = sorted(f.getPath().toString() for f in leaves if f.getLen() > 0)
        if leaves:
            months[month] = leaves[0]
    return dict(sorted(months.items()))


def header_of(spark: SparkSession, leaf: str, sep: str = SEPARATOR) -> tuple[str, ...]:
    """The column names in a file's first line, read by the driver without a job."""
    path, files = _file_system(spark, leaf)
    java = spark.sparkContext._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(files.open(path), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([(line or "").removeprefix("\ufeff")], delimiter=sep)))


def _reader(spark: SparkSession, sep: str):
    return spark.read.option("sep", sep).option("header", True)


def months_by_header(spark: SparkSession, months: Mapping[str, str], sep: str = SEPARATOR) -> dict[tuple[str, ...], list[str]]:
    """Month files grouped by header line. Reads one line per month, not per part file, several months at a time."""
    grouped: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = pool.map(lambda leaf: header_of(spark, leaf, sep), months.values())
        for month, header in zip(months, headers, strict=True):
            grouped.setdefault(header, []).append(month)
    return grouped


def empty_text(spark: SparkSession, columns: Sequence[str] = tuple(READING_TYPES)) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _text_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def _scan(spark: SparkSession, pattern: str, sep: str) -> DataFrame | None:
    """All month files as text, one scan per distinct header; None when there are no files."""
    months = month_files(spark, pattern)
    if not months:
        log.warning("no month files under %s", pattern)
        return None
    grouped = months_by_header(spark, months, sep)
    return union_by_name(
        [
            _reader(spark, sep).option("enforceSchema", False).schema(_text_schema(h)).csv([literal_path(f) for f in files])
            for h, files in grouped.items()
        ]
    )


def read_text_cells(spark: SparkSession, pattern: str, sep: str = SEPARATOR) -> DataFrame:
    """All month files as text columns, bound by name; columns a file lacks are NULL.

    ``enforceSchema`` is off, so every part file's own header is checked as it is read, and a
    file that deviates from its month fails instead of being mixed.
    """
    found = _scan(spark, pattern, sep)
    return empty_text(spark) if found is None else found


def typed(raw: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Cast the text cells; unnamed columns pass through as text, absent named ones are added as NULL."""
    types = {**READING_TYPES, **(types or {})}

    def column(name: str):
        text = F.col(f"`{name}`")
        type_name = types.get(name, "string")
        return (text if type_name == "string" else number_from_text(text, type_name)).alias(name)

    absent = [F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in raw.columns]
    return raw.select(*(column(c) for c in raw.columns), *absent)


def read_files(
    spark: SparkSession,
    pattern: str,
    types: Mapping[str, str] | None = None,
    infer: bool = False,
    sep: str = SEPARATOR,
) -> DataFrame:
    """Readings from the files of a pattern; none is no error.

    ``infer=True`` takes the types from the cells instead (``functions.kinds``): one more pass over the text, by
    one job for all files. Columns whose files disagree get a common type, and times stay text for ``clean`` to parse.
    """
    text = _scan(spark, pattern, sep)
    if text is None:
        return typed(empty_text(spark), types)
    return kinds.as_kinds(text, kinds.settled(text)) if infer else typed(text, types)


def _require(spark: SparkSession, root: str, patterns: Sequence[str]) -> None:
    """An error where nothing can be read: better than results that are empty for a mistyped name."""
    if not exists(spark, root):
        raise FileNotFoundError(f"{root} does not exist")
    for pattern in patterns:
        glob, files = _file_system(spark, f"{literal_path(root)}/{pattern}")
        if files.globStatus(glob):
            return
    raise FileNotFoundError(f"no month files under {root} for {', '.join(patterns)}")


def read_all(spark: SparkSession, root: str, **options) -> DataFrame:
    """Every month file in every period folder. A root that does not exist or holds none is an error."""
    _require(spark, root, [ALL_MONTHS])
    return read_files(spark, f"{literal_path(root)}/{ALL_MONTHS}", **options)


def read_folder(
    spark: SparkSession,
    root: str,
    period: Period,
    types: Mapping[str, str] | None = None,
    sep: str = SEPARATOR,
) -> DataFrame | None:
    """One period's folder, its rows labelled with that period; None when it has no folder or files.

    The label is a constant of the scan, not worked out from each row's path. It is coarse:
    ``classify`` replaces it by the period the date falls in.
    """
    if period.carpeta is None:
        return None
    found = _scan(spark, f"{literal_path(root)}/{literal_path(period.carpeta)}/{FOLDER_MONTHS}", sep)
    if found is None:
        return None
    label = (F.lit(period.num).alias("periodo_num"), F.lit(period.nombre).alias("periodo"))
    return typed(found, types).select("*", *label)


def read_periods(spark: SparkSession, root: str, periods: Sequence[Period] = PERIODS, **options) -> DataFrame:
    """The folders of the chosen periods, labelled; only these folders are listed and read.

    Some may be empty. That none of them holds a month file is an error.
    """
    _require(spark, root, [f"{literal_path(p.carpeta)}/{FOLDER_MONTHS}" for p in periods if p.carpeta])
    parts = [part for p in periods if (part := read_folder(spark, root, p, **options)) is not None]
    if not parts:
        empty = typed(empty_text(spark), options.get("types"))
        return empty.select(
            "*", F.lit(None).cast("int").alias("periodo_num"), F.lit(None).cast("string").alias("periodo")
        )
    return union_by_name(parts)

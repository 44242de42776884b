import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("aforo-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ts():
    return lambda text: dt.datetime.fromisoformat(text)


HEADER = "id;fecha;tipo_elem;intensidad;ocupacion;carga;vmed"


@pytest.fixture
def tree(tmp_path):
    """Month files by folder: ``write(folder, month, header, rows)``; returns the root."""

    def write(folder, month, rows, header=HEADER):
        path = tmp_path / folder
        path.mkdir(exist_ok=True)
        (path / f"{month}.csv").write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
        return str(tmp_path)

    write.root = str(tmp_path)
    return write


@pytest.fixture(scope="session")
def plan():
    """Text of a table's physical plan."""

    def plan_of(df, mode="formatted"):
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    return plan_of

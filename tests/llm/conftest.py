import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a table: ``frame("a int, b string", rows, parts)``."""

    def make(schema, rows, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make

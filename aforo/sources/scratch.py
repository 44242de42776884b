"""Where intermediate tables go: a shared folder, never a machine's own disk on a cluster."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession, scratch: str | None = None) -> str:
    """The given folder, else the session's ``spark.checkpoint.dir``, else one in its warehouse.

    All three are shared by the driver and the executors. Settings are read, never written.
    """
    root = scratch or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, purpose: str, scratch: str | None = None) -> str:
    """A new path for an intermediate table; ``release`` deletes it."""
    path = f"{scratch_root(spark, scratch)}/aforo-{purpose}-{uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, purpose: str, scratch: str | None = None) -> DataFrame:
    """The table written to a scratch path and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, purpose, scratch)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; DataFrames that still read them become invalid."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)

"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only where that setting is missing and Spark is local (tests, a laptop) a
    temporary folder takes its place; executors elsewhere would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tideline-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back, which cuts its lineage."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing reads them any more:
    what was stored since does not, as its lineage is cut."""
    for table in tables:
        _MADE.remove(table.stored_at)
        _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all that this process stored; results that read it are void.

    Returns the number of folders that went.
    """
    gone = 0
    while _MADE:
        gone += _delete(spark, _MADE.pop())
    return gone

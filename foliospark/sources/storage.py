"""Intermediate tables: written once to the folder that driver and executors share, gone when the interpreter ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a local session that names none, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table from ``stored`` that nothing reads any more."""
    folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    for spark, path in [w for w in _written if w[1].rsplit("/", 1)[1] in folders]:
        _written.remove((spark, path))
        _delete(spark, path)


def forget() -> None:
    """Deletes what was written so far."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as error:  # the gateway may be gone when the interpreter ends
        if "Py4J" not in type(error).__name__ and not isinstance(error, (ConnectionError, AttributeError)):
            raise

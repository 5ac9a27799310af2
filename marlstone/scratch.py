"""Written tables that cut lineage, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``.  Only a local session may leave it unset; it then gets
a folder of its own.  A table written here outlives any executor, so later stages reread it
instead of recomputing it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_NOW = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = context.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _OWN[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table that was written."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, with the path, for a caller that drops the table when done."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for held in getattr(_NOW, "open", ())[-1:]:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`cut_at`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that this thread cuts inside are dropped at the end, with or without an error."""
    held: list[str] = []
    _NOW.open = [*getattr(_NOW, "open", ()), held]
    try:
        yield
    finally:
        _NOW.open = _NOW.open[:-1]
        for path in held:
            drop(spark, path)

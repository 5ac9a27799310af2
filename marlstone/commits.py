"""Folders that are put into place by one rename, by one writer only."""

from __future__ import annotations

from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError

#: How often a change is made anew when another writer was faster.
ATTEMPTS = 20


def publish(spark: SparkSession, staged: str, final: str) -> bool:
    """Rename the folder ``staged`` to ``final``, on the same file system; false if ``final`` is already there.

    The rename refuses an existing target, in one step where the file system can (HDFS can).
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    never = gateway.new_array(rename, 1)
    never[0] = rename.valueOf("NONE")
    source, target = fs.Path(staged), fs.Path(final)
    context = fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, never)
    except Py4JJavaError as error:
        if context.util().exists(target) and context.util().exists(source):
            return False
        raise error
    return True

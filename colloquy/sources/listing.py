"""Files of a folder that Spark's readers pass over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def empty_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path) of the files of no bytes, with this suffix, in a folder, or matching a pattern, of any file system.

    Spark plans no split for them, so a reader gives no row. Names and sizes alone are listed, as Spark
    itself does, and only the empty ones are kept.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    found = []
    for top in fs.globStatus(place) or []:
        for s in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if not s.isDirectory() and s.getLen() == 0 and s.getPath().getName().endswith(suffix):
                found.append((s.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def with_empty(spark: SparkSession, path: str, suffix: str, rejected: DataFrame, name: str, reason: str) -> DataFrame:
    """rejected with a row for each file of no bytes: its path as `name`, `empty` as `reason`."""
    empty = empty_files(spark, path, suffix).select(F.col("path").alias(name), F.lit("empty").alias(reason))
    return rejected.unionByName(empty, allowMissingColumns=True)

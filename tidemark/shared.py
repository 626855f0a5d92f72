"""Intermediate tables in the folder that all executors share.

Writing a table there cuts the lineage: a lost executor costs the tasks of one
stage, never the whole job so far; and a table read twice is computed once.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Table:
    """A table written to the shared folder."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)

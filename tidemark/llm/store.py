"""Intermediate tables of the corpus operators, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import Table, delete, new_path, shared_dir

__all__ = ["Bucketed", "Table", "buckets", "delete", "new_path", "release", "shared_dir"]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs: its cleaner acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that a bucket is dealt as a partition is."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Bucketed:
    """A table in the shared folder, bucketed and sorted by a column, which joins on that column without a shuffle of its own.

    `df` should be partitioned by the column already; else each task writes a file for each bucket.
    """

    def __init__(self, df: DataFrame, name: str, column: str, count: int):
        self.spark, self.path, self.name = df.sparkSession, new_path(df.sparkSession, name), f"tidemark_{name}_{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.bucketBy(count, column).sortBy(column).option("path", self.path).format("parquet").saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def bare(self) -> DataFrame:
        """The files alone: the skew handling of adaptive execution needs both sides of a join shuffled."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

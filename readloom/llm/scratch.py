"""Intermediate tables in the shared folder that the cluster names.

Stages that are read more than once are written as Parquet under
``spark.checkpoint.dir`` and read back: lineage is cut, and a lost executor
costs no more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, a local folder."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH`` bytes to Python workers: a task holds a batch in the JVM, on its way and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


class Scratch:
    """Folders of one run of an operator; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/readloom-{tag}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of the written table."""
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``table``, for the only one that anything still reads: the others go."""
        out = self.table(df, name)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder):
            if status.getPath().getName() != name:
                self.drop(status.getPath().getName())
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""Steps of a job written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; only where that is unset and all runs on
    this machine, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Called with each frame before it is written: an audit looks at the plans of a job's steps.
WATCHERS: list[Callable[[DataFrame], None]] = []


class Steps:
    """What a job has written on its way; drop() takes it away once the job's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read again: plans stay small and survive lost executors."""
        for watch in WATCHERS:
            watch(df)
        path = folder(self.spark, "stage")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def cut(df: DataFrame, keep: list) -> DataFrame:
    """df's columns written to the shared folder, where they stay, and read again."""
    return Steps(df.sparkSession).cut(df.select(*keep))

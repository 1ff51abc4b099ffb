"""Parquet stores of bars and features, partitioned so that reads prune."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.bars import PRICES
from barlake.plans.manifest import Manifest
from barlake.sources.scratch import cut

KEYS = ["symbol", "tf", "year", "month"]


class StorageError(ValueError):
    pass


class NoStore(StorageError):
    """There is nothing under a path."""


def months(tf: str):
    month = F.lit("01") if tf == "1d" else F.date_format("close_time", "MM")
    return {"tf": F.lit(tf), "year": F.date_format("close_time", "yyyy"), "month": month}


def write_bars(bars: DataFrame, root: str, tf: str, overwrite: bool = True) -> None:
    """Partitions that bars touch are replaced; without overwrite old rows stay where no new one has their close time."""
    cols = ["symbol", "open_time", "close_time", *PRICES, "volume"]
    new = bars.select(*cols).withColumns(months(tf))
    if not overwrite:
        try:
            old = _tree(bars.sparkSession, root)
        except NoStore:
            old = None
        if old is not None:
            touched = new.select(*KEYS).distinct()
            both = old.select(*cols, *KEYS[1:]).join(touched, KEYS, "left_semi").withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            w = W.partitionBy("symbol", "tf", "close_time").orderBy(F.desc("_new"))
            merged = both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")
            new = cut(merged, [*cols, *KEYS[1:]])
    out = new.repartition(*KEYS).sortWithinPartitions("close_time")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*KEYS).parquet(root)


def _tree(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.option("basePath", root).schema("open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, symbol string, tf string, year string, month string").parquet(root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise NoStore(f"no bars under {root}") from e
        raise  # a store that cannot be read now is still there


def read_bars(spark: SparkSession, root: str, symbol: str, tf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with close times from start to end, both included; years outside are not listed."""
    out = _tree(spark, root).where((F.col("symbol") == symbol) & (F.col("tf") == tf))
    if start:
        out = out.where((F.col("close_time") >= F.lit(start).cast("timestamp")) & (F.col("year") >= start[:4]))
    if end:
        out = out.where((F.col("close_time") <= F.lit(end).cast("timestamp")) & (F.col("year") <= end[:4]))
    if out.isEmpty():
        raise StorageError(f"no bars of {symbol} {tf} under {root}")
    return out.select("symbol", "open_time", "close_time", *PRICES, "volume")


def store_summary(spark: SparkSession, root: str) -> DataFrame:
    return _tree(spark, root).groupBy("symbol", "tf").agg(F.count("*").alias("n_rows"), F.min("close_time").alias("first_close"), F.max("close_time").alias("last_close"))


def write_report(spark: SparkSession, path: str, value: dict) -> None:
    """value as one line of JSON, by Spark's writer, so that path may lie in any store."""
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def write_features(matrix: DataFrame, made: Manifest, root: str) -> str:
    """The matrix under fs_version=/symbol=/year=/month=, its manifest as a text beside the data."""
    path = f"{root}/fs_version={made.version}"
    out = matrix.withColumns({"year": F.date_format("close_time", "yyyy"), "month": F.date_format("close_time", "MM")})
    out.repartition("symbol", "year", "month").sortWithinPartitions("close_time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "year", "month").parquet(path)
    about = {"manifest": asdict(made), "n_rows": matrix.sparkSession.read.parquet(path).count(), "created_at": datetime.now(UTC).isoformat()}
    matrix.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_manifests/{made.version}")
    return path


def read_manifest(spark: SparkSession, root: str, version: str) -> Manifest:
    return Manifest(**json.loads(spark.read.text(f"{root}/_manifests/{version}").first().value)["manifest"])


def read_features(spark: SparkSession, root: str, version: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    made = read_manifest(spark, root, version)
    out = spark.read.option("basePath", f"{root}/fs_version={version}").parquet(f"{root}/fs_version={version}").where(F.col("symbol") == symbol)
    made.assert_compatible([c for c in out.columns if c not in ("symbol", "close_time", "year", "month")])
    month = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    if start:
        out = out.where((F.col("close_time") >= F.lit(start).cast("timestamp")) & (month >= start[:7]))
    if end:
        out = out.where((F.col("close_time") <= F.lit(end).cast("timestamp")) & (month <= end[:7]))
    return out.select("symbol", "close_time", *made.names)


def list_feature_sets(spark: SparkSession, root: str) -> DataFrame:
    """fs_version, symbol, number of features and rows, and time of writing of each feature set, the latest first."""
    part = lambda k: F.get_json_object("value", f"$.{k}")
    sets = spark.read.option("recursiveFileLookup", True).text(f"{root}/_manifests")
    out = sets.select(part("manifest.version").alias("fs_version"), part("manifest.symbol").alias("symbol"), F.json_array_length(part("manifest.columns")).alias("n_features"), part("n_rows").cast("long").alias("n_rows"), part("created_at").cast("timestamp").alias("created_at"))
    return out.orderBy(F.desc("created_at"))

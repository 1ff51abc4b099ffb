"""Scans over one long series in many tasks: buckets of time, a short table of what each bucket hands on, then rows.

A window over a whole series is one task. Here rows are dealt by series and bucket. What a bucket leaves, its last
values or its number of rows, is one row of a table that a window over the buckets adds up; each bucket's rows then start
from what the buckets before it left. Nothing is cut off: values are carried over any number of empty buckets.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds of a bucket: 2,016 bars of five minutes.
WEEK = 7 * 86_400
BUCKET = "_bucket"


def bucket(ts: str | Column, seconds: int = WEEK) -> Column:
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / (seconds * 1_000_000))


def before(keys: Sequence[str]):
    """The buckets of a series before each."""
    return W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)


def carried(df: DataFrame, values: dict[str, Column], order: Sequence[str], keys: Sequence[str] = ("symbol",), strict: Collection[str] = ()) -> DataFrame:
    """df, which has BUCKET, with the last value that is not null of each of values at every row or before it; of the names
    in strict, before it. order sorts the rows of a series, and buckets follow it."""
    keys, place = list(keys), F.struct(*order)
    ends = df.groupBy(*keys, BUCKET).agg(*(F.max_by(v, F.when(v.isNotNull(), place)).alias(n) for n, v in values.items()))
    ends = ends.select(*keys, BUCKET, *(F.last(n, True).over(before(keys)).alias(f"_from_{n}") for n in values))
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order)
    until = lambda n: inside.rowsBetween(W.unboundedPreceding, -1 if n in strict else 0)
    rows = df.withColumns({n: F.last(v, True).over(until(n)) for n, v in values.items()}).join(ends, [*keys, BUCKET], "left")
    return rows.withColumns({n: F.coalesce(n, f"_from_{n}") for n in values}).drop(*(f"_from_{n}" for n in values))


def totals(df: DataFrame, values: dict[str, Column], order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """df, which has BUCKET, with the sum of each of values up to and with every row; nulls count as 0."""
    keys = list(keys)
    zero = {n: F.coalesce(v, F.lit(0)) for n, v in values.items()}
    ends = df.groupBy(*keys, BUCKET).agg(*(F.sum(v).alias(n) for n, v in zero.items()))
    ends = ends.select(*keys, BUCKET, *(F.coalesce(F.sum(n).over(before(keys)), F.lit(0)).alias(f"_from_{n}") for n in values))
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns({n: F.sum(v).over(inside) for n, v in zero.items()}).join(ends, [*keys, BUCKET])
    return rows.withColumns({n: F.col(n) + F.col(f"_from_{n}") for n in values}).drop(*(f"_from_{n}" for n in values))


def numbered(df: DataFrame, seconds: int = WEEK, ts: str = "close_time") -> DataFrame:
    """df with rn, each row's number within its symbol from 0 on."""
    rows = totals(df.withColumn(BUCKET, bucket(ts, seconds)), {"rn": F.lit(1).cast("long")}, [ts])
    return rows.withColumn("rn", F.col("rn") - 1).drop(BUCKET)

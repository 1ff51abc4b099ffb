"""Bars: their columns, their contract, and how ticks become bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), *(T.StructField(c, T.TimestampType()) for c in ("open_time", "close_time")), *(T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume"))])


class SchemaError(ValueError):
    """A frame breaks the bar contract."""


class DataQualityError(ValueError):
    """Data are too bad to go on."""


class ResampleError(ValueError):
    """Bars cannot be resampled as asked."""


def ticks_to_bars(ticks: DataFrame, minutes: int, ts: str = "ts", price: Column | str = "value", tick_id: str = "event_id", symbol: Column | None = None) -> DataFrame:
    """Bars of so many minutes: first, largest, smallest and last price, and the number of ticks as volume.

    One shuffle with partial aggregates; ties in time are settled by the tick's id.
    """
    price = F.col(price) if isinstance(price, str) else price
    t = F.col(ts).cast("timestamp")
    rows = ticks.select((symbol if symbol is not None else F.lit("ALL")).alias("symbol"), t.alias("t"), F.col(tick_id).alias("i"), price.alias("p"))
    step = minutes * 60_000_000
    rows = rows.withColumn("open_time", F.timestamp_micros(F.floor(F.unix_micros("t") / step) * step))
    at = F.struct("t", "i")
    out = rows.groupBy("symbol", "open_time").agg(F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count("p").cast("double").alias("volume"))
    return out.select("symbol", "open_time", (F.col("open_time") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("close_time"), *PRICES, "volume")


def contract(df: DataFrame, minutes: int) -> DataFrame:
    """One row: rows, repeated close times, and rows whose duration is wrong (days may have 23 to 25 hours)."""
    span = F.col("close_time").cast("long") - F.col("open_time").cast("long")
    good = span.isin(*(h * 3600 for h in (23, 24, 25))) if minutes == 1440 else span == minutes * 60
    return df.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("symbol", "close_time")).alias("repeated"), F.sum((~good).cast("long")).alias("bad_duration"))


def check(df: DataFrame, minutes: int) -> DataFrame:
    """df, if it keeps the contract."""
    missing = {f.name for f in SCHEMA} - set(df.columns)
    if missing:
        raise SchemaError(f"missing columns: {sorted(missing)}")
    row = contract(df, minutes).first()
    if row.repeated or row.bad_duration:
        raise SchemaError(f"{row.repeated} repeated close times, {row.bad_duration} wrong durations")
    return df


def as_of(df: DataFrame, ts: str) -> DataFrame:
    """Bars closed at ts or before."""
    return df.where(F.col("close_time") <= F.lit(ts).cast("timestamp"))

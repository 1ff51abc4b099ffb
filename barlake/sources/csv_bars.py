"""CSV bars: any common dialect, read as strings by Spark and cast explicitly. Parses, never repairs."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.bars import PRICES, SchemaError
from barlake.timeframes import bar_times

# Column names that feeds use, and stamp formats that are tried in turn.
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "price": "close", "vol": "volume", "tickvol": "volume", "tick_volume": "volume", "tickvolume": "volume"}
STAMPS = ("datetime", "date_time", "timestamp", "time", "date", "gmt_time")
FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "dd.MM.yyyy HH:mm:ss.SSS", "dd.MM.yyyy HH:mm:ss", "yyyyMMdd HHmmss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm")


@dataclass(frozen=True)
class CsvSource:
    path: str = ""
    minutes: int = 5
    convention: str = "open"
    source_tz: str | None = None
    delimiter: str | None = None
    decimal: str = "."
    skip_rows: int = 0
    date_column: str | None = None
    time_column: str | None = None
    timestamp_column: str | None = None
    volume_column: str | None = None
    column_map: dict[str, str] = field(default_factory=dict)
    symbol: str = "ALL"


def normal(name: str) -> str:
    """A column name in lower case: its words, without quotes, angle brackets or a byte order mark, joined by underscores."""
    return "_".join(re.findall(r"[^\s<>\"\ufeff]+", name.lower()))


def head(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first lines, by Spark's reader, so the path may be in any store."""
    return [r.value for r in spark.read.text(path).limit(lines).collect()]


def sniff(lines: list[str]) -> str:
    """The separator that all lines hold equally often, else the most frequent."""
    best = max(",;\t|", key=lambda d: (len({line.count(d) for line in lines}) == 1 and lines[0].count(d) > 0, sum(line.count(d) for line in lines)))
    return best


def to_utc(local: Column, tz: str | None) -> Column:
    """UTC of local stamps; times in a spring gap move forward, repeated ones take the earlier offset."""
    return F.to_utc_timestamp(local, tz) if tz else local


def second_passes(rows: DataFrame, tz: str) -> DataFrame:
    """rows (_id, _t, ...) with an hour added where a repeated local hour is passed for the second time.

    There stamps lie at or before the latest one so far. That is carried through each input split, and from split to split
    by the largest stamp of each.
    """
    split = F.shiftright("_id", 33)
    ends = rows.groupBy(split.alias("_split")).agg(F.max("_t").alias("_end"))
    ends = ends.select("_split", F.max("_end").over(W.orderBy("_split").rowsBetween(W.unboundedPreceding, -1)).alias("_end"))  # one row for each split
    out = rows.withColumn("_split", split).join(ends, "_split", "left")
    before = W.partitionBy("_split").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_prev", F.greatest(F.max("_t").over(before), "_end"))
    later = F.col("_t") + F.expr("INTERVAL 1 HOUR")
    again = (F.col("_prev") >= F.col("_t")) & (F.from_utc_timestamp(later, tz) == F.from_utc_timestamp("_t", tz))
    return out.withColumn("_t", F.when(again, later).otherwise(F.col("_t"))).select(rows.columns)


def load(spark: SparkSession, src: CsvSource) -> DataFrame:
    """symbol, open_time, close_time, prices, volume and row_no of a CSV file, in its order, faults and all."""
    lines = head(spark, src.path, src.skip_rows + 20)[src.skip_rows :]
    if not lines:
        raise SchemaError(f"{src.path} is empty")
    sep = src.delimiter or sniff(lines)
    split_row = lambda text, n: F.from_csv(text, F.lit(", ".join(f"c{i} string" for i in range(n))), {"sep": sep, "quote": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    header = next(csv.reader([lines[0]], delimiter=sep))
    header = [normal(x) for x in header]
    raw = spark.read.text(src.path).select("value", F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_block_start").alias("_block"))
    # The preamble and the header are known by their place, the first lines of the first block, not by what they hold.
    first = (F.col("_block") == 0) & (F.col("_id").bitwiseAND((1 << 33) - 1) <= src.skip_rows)
    rows = raw.where(~first & (F.trim("value") != "")).withColumn("_row", split_row(F.col("value"), len(header)))
    names, taken = {}, set()
    for i, h in enumerate(header):
        name = src.column_map.get(h, ALIASES.get(h, h))
        if src.volume_column:
            name = "volume" if h == normal(src.volume_column) else (f"_{name}" if name == "volume" else name)
        if name not in taken:
            taken.add(name)
            names[name] = i
    value = {n: F.col(f"_row.c{i}") for n, i in names.items()}
    if missing := set(PRICES) - set(value):
        raise SchemaError(f"missing columns: {sorted(missing)}")
    date, time = (normal(c) if c else d for c, d in ((src.date_column, "date"), (src.time_column, "time")))
    if (src.date_column and src.time_column) or (not src.timestamp_column and {"date", "time"} <= set(value)):
        text = F.concat_ws(" ", value[date], value[time])
    else:
        key = normal(src.timestamp_column) if src.timestamp_column else next((s for s in STAMPS if s in value), None)
        if key not in value:
            raise SchemaError("no timestamp column")
        text = value[key]
    zoned = text.rlike(r"([+-]\d\d:?\d\d|Z)$")
    plain = F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))
    stamp = F.when(zoned, F.try_to_timestamp(text)).otherwise(to_utc(plain, src.source_tz))
    number = lambda c: (F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".") if src.decimal == "," else c).try_cast("double")
    o, e = bar_times(F.col("_t"), src.minutes, src.convention)
    out = rows.select("_id", stamp.alias("_t"), text.alias("_text"), *(number(value[p]).alias(p) for p in PRICES), (number(value["volume"]) if "volume" in value else F.lit(None).cast("double")).alias("volume"))
    bad = [r._text for r in out.where("_t IS NULL").select("_text").limit(3).collect()]
    if bad:
        raise SchemaError(f"unreadable stamps: {bad}")
    if src.source_tz:
        out = second_passes(out, src.source_tz)
    return out.select(F.lit(src.symbol).alias("symbol"), o.alias("open_time"), e.alias("close_time"), *PRICES, "volume", F.col("_id").alias("row_no"))


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a source file, taken by Spark's reader, so that it may lie in any store; a file of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]

"""Bars of a coarser timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.bars import ResampleError
from barlake.calendars import Calendar, clock
from barlake.timeframes import floor_time


def bounds(open_time: Column, minutes: int, offset: int = 0, tz: str = "America/New_York", anchor: str = "17:00") -> tuple[Column, Column]:
    """Open and close of the coarse bar that holds open_time; days run between wall-clock anchors of tz."""
    if minutes != 1440:
        start = floor_time(open_time, minutes, offset)
        return start, start + F.expr(f"INTERVAL {minutes} MINUTES")
    shift = F.expr(f"INTERVAL {clock(anchor)} MINUTES")
    day = F.date_trunc("day", F.from_utc_timestamp(open_time, tz) - shift)
    return F.to_utc_timestamp(day + shift, tz), F.to_utc_timestamp(day + F.expr("INTERVAL 1 DAY") + shift, tz)


def resample(bars: DataFrame, base: int, target: int, calendar: Calendar | None = None, offset: int = 0, tz: str = "America/New_York", anchor: str = "17:00", min_share: float = 0.5, drop_last: bool = True) -> DataFrame:
    """OHLCV of each coarse bar with n_base_bars and is_partial; the last bar goes if it has not closed.

    A bar is partial if it has less than min_share of the bars that the calendar expects in it or, without a calendar,
    of the most frequent number of bars of its symbol. One shuffle with partial aggregates.
    """
    if target <= base or (target % base and target != 1440):
        raise ResampleError(f"{target} minutes is no coarser multiple of {base}")
    o, e = bounds(F.col("open_time"), target, offset, tz, anchor)
    rows = bars.withColumns({"_o": o, "_e": e})
    out = rows.groupBy("symbol", "_o", "_e").agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.count("*").alias("n_base_bars"),
    )
    last = bars.groupBy("symbol").agg(F.max("close_time").alias("_last"))
    if calendar:
        grid = out.select("symbol", "_o", F.explode(F.sequence(F.col("_o"), F.col("_e") - F.expr(f"INTERVAL {base} MINUTES"), F.expr(f"INTERVAL {base} MINUTES"))).alias("t"))
        want = grid.where(calendar.is_open(F.col("t"))).groupBy("symbol", "_o").agg(F.count("*").alias("_want"))
        out = out.join(want, ["symbol", "_o"], "left").join(last, "symbol")
    else:
        out = out.join(out.groupBy("symbol").agg(F.mode("n_base_bars", True).alias("_want")), "symbol").join(last, "symbol")
    if drop_last:
        out = out.where(F.col("_e") <= F.col("_last"))
    partial = F.coalesce(F.col("n_base_bars") / F.when(F.col("_want") > 0, F.col("_want")), F.lit(1.0)) < min_share
    return out.select("symbol", F.col("_o").alias("open_time"), F.col("_e").alias("close_time"), "open", "high", "low", "close", "volume", "n_base_bars", partial.alias("is_partial"))


def resample_many(bars: DataFrame, base: int, targets: list[int], **options) -> dict[int, DataFrame]:
    return {t: resample(bars, base, t, **options) for t in targets}

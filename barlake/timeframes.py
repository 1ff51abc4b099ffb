"""Timeframes and time grids."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Timeframe(str, Enum):
    M1, M5, M15, H1, H4, D1 = "1m", "5m", "15m", "1h", "4h", "1d"

    @property
    def minutes(self) -> int:
        return int(self.value[:-1]) * {"m": 1, "h": 60, "d": 1440}[self.value[-1]]

    @property
    def bars_per_day(self) -> int:
        return max(1, 1440 // self.minutes)

    @property
    def interval(self) -> Column:
        return F.expr(f"INTERVAL {self.minutes} MINUTES")


def floor_time(ts: Column, minutes: int, offset_minutes: int = 0) -> Column:
    """Start of the grid cell that holds ts; cells begin at the epoch plus an offset."""
    step, shift = minutes * 60_000_000, offset_minutes * 60_000_000
    return F.timestamp_micros(F.floor((F.unix_micros(ts) - shift) / step) * step + shift)


def on_grid(ts: Column, minutes: int) -> Column:
    return F.unix_micros(ts) % (minutes * 60_000_000) == 0


def grid(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """open_time from start to end, both included."""
    if start > end:
        raise ValueError("the end lies before the start")
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {minutes} MINUTES)) AS open_time")


def bar_times(ts: Column, minutes: int, convention: str) -> tuple[Column, Column]:
    """(open_time, close_time) of a stamp that marks a bar's open or close."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    if convention not in ("open", "close"):
        raise ValueError("the convention is open or close")
    return (ts, ts + step) if convention == "open" else (ts - step, ts)

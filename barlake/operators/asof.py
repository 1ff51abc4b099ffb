"""Backward as-of joins as a union and a scan of last values: no pairs, and no window over a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.scan import BUCKET, WEEK, bucket, carried


class LeakageError(ValueError):
    """A row sees data from after its decision time."""


def asof_many(base: DataFrame, others: dict[str, tuple[DataFrame, list[str]]], strict: bool = False, ts: str = "close_time", seconds: int = WEEK) -> DataFrame:
    """base with a struct column for each of others: the named columns, and _at, of its latest row at ts or before (strict:
    before ts). All tables go through one union, dealt by symbol and buckets of so many seconds, so that one long series is
    the work of many tasks; the latest row may lie any number of buckets back."""
    left = base.select("symbol", F.col(ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct("*").alias("_base"))
    for name, (other, cols) in others.items():
        values = F.struct(*(F.col(x).alias(x) for x in cols), F.col(ts).alias("_at"))
        right = other.select("symbol", F.col(ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"), values.alias(name))
        left = left.unionByName(right, allowMissingColumns=True)
    both = carried(left.withColumn(BUCKET, bucket("_t", seconds)), {name: F.col(name) for name in others}, ["_t", "_side"])
    return both.where(F.col("_base").isNotNull()).select("_base.*", *others)


def asof(base: DataFrame, other: DataFrame, cols: list[str], strict: bool = False, suffix: str = "", ts: str = "close_time", matched: str | None = None, seconds: int = WEEK) -> DataFrame:
    """base with the cols of the latest row of other, of the same symbol, at ts or before; strict: before ts."""
    out = asof_many(base, {"_v": (other, cols)}, strict, ts, seconds)
    named = [F.col(f"_v.{x}").alias(f"{x}{suffix}") for x in cols]
    return out.select(*base.columns, *named, *([F.col("_v._at").alias(matched)] if matched else []))


def verify(df: DataFrame, matched: str, ts: str = "close_time") -> DataFrame:
    """df, if no matched time lies after ts."""
    if not df.where(F.col(matched) > F.col(ts)).isEmpty():
        raise LeakageError(f"{matched} lies after {ts}")
    return df


def completed_levels(bars: DataFrame, keys: dict[str, Column], base: DataFrame | None = None) -> DataFrame:
    """base, or bars, with <name>_high and <name>_low of each key: those of its last group that ended before each row.

    keys are columns of bars by name; rows whose key is null belong to no group. All keys are added up in one shuffle.
    """
    base = bars if base is None else base
    groups = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.to_json(F.struct(k.alias("k"))).alias("key"), k.isNotNull().alias("has")) for n, k in keys.items())))
    each = bars.select("symbol", "close_time", "high", "low", groups.alias("g")).where("g.has")
    ends = each.groupBy("symbol", "g.level", "g.key").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("close_time").alias("close_time"))
    tables = {f"_level_{n}": (ends.where(F.col("level") == n), ["high", "low"]) for n in keys}
    out = asof_many(base, tables, strict=True)
    return out.select(*base.columns, *(F.col(f"_level_{n}.{x}").alias(f"{n}_{x}") for n in keys for x in ("high", "low")))

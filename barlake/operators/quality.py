"""Validation that reports, gap analysis, cleaning that repairs, and the gate between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.bars import PRICES, DataQualityError
from barlake.calendars import Calendar
from barlake.functions.rolling import flag
from barlake.operators import scan
from barlake.sources.scratch import Steps
from barlake.timeframes import on_grid

# How grave each kind of fault is. Too many nulls are an error.
SEVERITY = {
    "duplicate_timestamp": "WARNING", "non_monotonic": "WARNING", "off_grid": "WARNING", "null_value": "WARNING", "non_positive_price": "ERROR", "ohlc_inconsistent": "ERROR",
    "flat_bar": "INFO", "negative_volume": "ERROR", "zero_volume": "INFO", "extreme_return": "WARNING",
}
ERRORS = frozenset({*(k for k, v in SEVERITY.items() if v == "ERROR"), "null_value"})


def any_price(test) -> Column:
    out = F.lit(False)
    for p in PRICES:
        out = out | F.coalesce(test(F.col(p)), F.lit(False))
    return out


def inconsistent() -> Column:
    o, h, lo, cl = (F.col(p) for p in PRICES)
    return F.coalesce((h < lo) | (h < o) | (h < cl) | (lo > o) | (lo > cl), F.lit(False))


#: Row numbers of a bucket: the bar before each comes from a scan over buckets, so that one long series is the work of many tasks.
BUCKET_ROWS = 100_000


def with_bar_before(bars: DataFrame, value: Column, row_no: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bars with before, a struct of the value that the bar before has in file order; null for a symbol's first bar.

    Bars without a symbol are a series of their own, and those without a row number come first."""
    rows = bars.withColumns({"_series": F.struct("symbol"), scan.BUCKET: F.coalesce(F.floor(F.col(row_no) / bucket_rows), F.lit(-(1 << 63)))})
    return scan.carried(rows, {"before": F.struct(value.alias("value"))}, [row_no], ["_series"], strict=["before"]).drop("_series", scan.BUCKET)


def faults_of_row(minutes: int) -> dict[str, Column]:
    """The kinds of fault that a row shows by itself, never null."""
    faults = {
        "off_grid": ~on_grid(F.col("close_time"), minutes),
        "null_value": any_price(lambda p: p.isNull()),
        "non_positive_price": any_price(lambda p: p <= 0),
        "ohlc_inconsistent": inconsistent(),
        "flat_bar": F.col("high") == F.col("low"),
        "negative_volume": F.col("volume") < 0,
        "zero_volume": F.col("volume") == 0,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in faults.items()}


def goes_back() -> Column:
    """Whether a bar of with_bar_before() closes before the one before it."""
    return F.coalesce(F.col("close_time") < F.col("before.value"), F.lit(False))


def marked(bars: DataFrame, minutes: int, row_no: str = "row_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bars with a boolean column for each kind of fault; order is that of the file."""
    rows = with_bar_before(bars, F.col("close_time"), row_no, bucket_rows).withColumn("non_monotonic", goes_back()).drop("before")
    copies = F.row_number().over(W.partitionBy("symbol", "close_time").orderBy(row_no))
    return rows.withColumns({"duplicate_timestamp": copies > 1, **faults_of_row(minutes)})


KINDS = tuple(k for k in SEVERITY if k != "extreme_return")


def issues(bars: DataFrame, minutes: int, row_no: str = "row_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(issue, n): how many rows of each kind of fault bars has.

    Most are counted where the rows are read. Only close times are shuffled: counted by symbol and time for the copies, and
    dealt by buckets of row numbers for those that go back, so no task holds a series or a time that many rows have."""
    order = bars.select("symbol", "close_time", row_no)
    alone = bars.agg(*(F.count_if(v).alias(k) for k, v in faults_of_row(minutes).items()))
    copies = order.groupBy("symbol", "close_time").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_timestamp"))
    back = with_bar_before(order, F.col("close_time"), row_no, bucket_rows).agg(F.count_if(goes_back()).alias("non_monotonic"))
    return alone.crossJoin(copies).crossJoin(back).unpivot([], list(KINDS), "issue", "n")


def findings(bars: DataFrame, minutes: int, sigma: float = 12.0, max_null: float = 0.01, zero_volume: bool = True, examples: int = 3) -> list[dict]:
    """The faults that bars has: issue, severity, count, share of the rows, and the first few close times in file order."""
    rows = marked(bars, minutes)
    counts = rows.agg(F.count("*").alias("rows"), *(F.count_if(k).alias(k) for k in KINDS)).first()
    extreme = extreme_returns(bars, sigma)
    found = {k: (counts[k], rows.where(k).orderBy("row_no")) for k in KINDS if counts[k] and (k != "zero_volume" or zero_volume)}
    if n := extreme.count():
        found["extreme_return"] = n, extreme.orderBy("close_time")
    out = []
    for kind, (n, faulty) in found.items():
        severity = "ERROR" if kind == "null_value" and n > max_null * counts.rows else SEVERITY[kind]
        out.append({"issue": kind, "severity": severity, "count": n, "share": n / counts.rows, "examples": [str(r.close_time) for r in faulty.select("close_time").limit(examples).collect()]})
    return out


def medians(df: DataFrame, value: str, key: str = "symbol", slack: float = 5e-4) -> DataFrame:
    """(key, median, n): the exact median of each key's values that are not null, the mean of the middle two of an even number.

    A sketch tells bounds that surely hold the middle values, as its ranks are off by 1e-4 of n at most. One more pass
    counts what lies below them; only the few distinct values between them are put in order. No task holds a key's values.
    """
    x = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("x"))
    bounds = x.groupBy(key).agg(F.percentile_approx("x", [0.5 - slack, 0.5 + slack], 10_000).alias("b"), F.count("*").alias("n"))
    near = x.join(bounds, key).select(key, "n", F.when(F.col("x") < F.col("b")[0], None).otherwise(F.col("x")).alias("x"), (F.col("x") > F.col("b")[1]).alias("above"))
    steps = near.where(~F.col("above")).groupBy(key, "n", "x").agg(F.count("*").alias("m"))  # null: all those below, in one row
    upto = W.partitionBy(key).orderBy(F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = steps.withColumn("upto", F.sum("m").over(upto))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    return ranked.groupBy(key, "n").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def extreme_returns(bars: DataFrame, sigma: float = 12.0, least: int = 100, row_no: str = "row_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Bars whose log return lies more than sigma robust deviations from the median of its symbol.

    The bar before each comes from a scan over buckets of row numbers, the medians from sketches, so that one long series is
    the work of many tasks."""
    steps = Steps(bars.sparkSession)
    logs = bars.select("symbol", "close_time", row_no, F.when(F.col("close") > 0, F.log("close")).alias("log"), F.floor(F.col(row_no) / bucket_rows).alias(scan.BUCKET))
    before = scan.carried(logs, {"before": F.struct("log")}, [row_no], strict=["before"])
    r = steps.cut(before.select("symbol", "close_time", (F.col("log") - F.col("before.log")).alias("ret")).where("ret IS NOT NULL"))
    dev = r.join(medians(r, "ret").where(F.col("n") >= least), "symbol").withColumn("off", F.abs(F.col("ret") - F.col("median")))
    mad = medians(dev, "off").select("symbol", (1.4826 * F.col("median")).alias("mad")).where("mad > 0")
    return dev.join(mad, "symbol").where(F.col("off") / F.col("mad") > sigma).select("symbol", "close_time", "ret")


def missing_bars(bars: DataFrame, minutes: int, calendar: Calendar | None = None) -> DataFrame:
    """(symbol, open_time) of the calendar's bars between a symbol's first and last that are not there."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    span = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", step)).alias("open_time"))
    if calendar:
        grid = grid.where(calendar.is_open(F.col("open_time")))
    return grid.join(bars.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")


def gap_runs(bars: DataFrame, minutes: int, calendar: Calendar | None = None, top: int | None = 20) -> DataFrame:
    """Runs of missing bars (symbol, gap_start, gap_end, n_bars), the longest top of them."""
    w = W.partitionBy("symbol").orderBy("open_time")
    new = flag(F.col("open_time").cast("long") - F.lag("open_time").over(w).cast("long") != minutes * 60)
    runs = missing_bars(bars, minutes, calendar).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy("symbol", "_run").agg(F.min("open_time").alias("gap_start"), (F.max("open_time") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("gap_end"), F.count("*").alias("n_bars")).drop("_run")
    return out.orderBy(F.desc("n_bars"), "gap_start", "symbol").limit(top) if top else out


def completeness(bars: DataFrame, minutes: int, calendar: Calendar | None = None) -> DataFrame:
    """(symbol, expected, missing, completeness); 0 where nothing is expected."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    span = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", step)).alias("open_time"))
    if calendar:
        grid = grid.where(calendar.is_open(F.col("open_time")))
    have = grid.join(bars.select("symbol", "open_time", F.lit(1).alias("here")).distinct(), ["symbol", "open_time"], "left")
    out = have.groupBy("symbol").agg(F.count("*").alias("expected"), (F.count("*") - F.count("here")).alias("missing"))
    return out.withColumn("completeness", F.when(F.col("expected") > 0, 1 - F.col("missing") / F.col("expected")).otherwise(0.0))


@dataclass(frozen=True)
class Cleaning:
    duplicates: str = "keep_last"
    drop_null: bool = True
    drop_non_positive: bool = True
    drop_inconsistent: bool = True
    clip_inconsistent: bool = False
    drop_off_grid: bool = True
    max_fill: int = 0


def reason(minutes: int, rules: Cleaning = Cleaning()) -> Column:
    """The first rule by which a row goes, or null."""
    tests = [("null_price", rules.drop_null, any_price(lambda p: p.isNull())), ("non_positive", rules.drop_non_positive, any_price(lambda p: p <= 0))]
    tests += [("inconsistent", rules.drop_inconsistent and not rules.clip_inconsistent, inconsistent()), ("off_grid", rules.drop_off_grid, ~on_grid(F.col("close_time"), minutes))]
    out = F.lit(None).cast("string")
    for name, on, test in reversed(tests):
        if on:
            out = F.when(test, name).otherwise(out)
    return out


def clip_prices(bars: DataFrame) -> DataFrame:
    """high and low widened over open and close where a row contradicts itself."""
    bad = inconsistent()
    return bars.withColumns({"high": F.when(bad, F.greatest("high", "open", "close")).otherwise(F.col("high")), "low": F.when(bad, F.least("low", "open", "close")).otherwise(F.col("low"))})


def dedupe(bars: DataFrame, policy: str = "keep_last", row_no: str = "row_no") -> DataFrame:
    key = W.partitionBy("symbol", "close_time")
    if policy == "raise":
        if not bars.groupBy("symbol", "close_time").count().where("count > 1").isEmpty():
            raise ValueError("repeated close times")
        return bars
    order = F.desc(row_no) if policy == "keep_last" else F.asc(row_no)
    return bars.withColumn("_k", F.row_number().over(key.orderBy(order))).where("_k = 1").drop("_k")


def fill_gaps(bars: DataFrame, minutes: int, max_run: int) -> DataFrame:
    """bars with flat bars at the last close in gaps of max_run bars at most, marked is_synthetic."""
    w, step = W.partitionBy("symbol").orderBy("close_time"), F.expr(f"INTERVAL {minutes} MINUTES")
    gap = (F.lead("close_time").over(w).cast("long") - F.col("close_time").cast("long")) / (minutes * 60) - 1
    small = bars.withColumn("_m", F.floor(gap)).where((F.col("_m") >= 1) & (F.col("_m") <= max_run))
    new = small.select("symbol", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_i"), "close_time", F.col("close").alias("p"))
    at = F.timestamp_micros(F.unix_micros("close_time") + F.col("_i") * (minutes * 60_000_000))
    new = new.select("symbol", (at - step).alias("open_time"), at.alias("close_time"), *(F.col("p").alias(x) for x in PRICES), F.lit(0.0).alias("volume"), F.lit(True).alias("is_synthetic"))
    return bars.select("symbol", "open_time", "close_time", *PRICES, "volume", F.lit(False).alias("is_synthetic")).unionByName(new)


def clean(bars: DataFrame, minutes: int, rules: Cleaning = Cleaning(), row_no: str = "row_no") -> DataFrame:
    """Rows that no rule drops, one for each close time, filled where asked."""
    if rules.clip_inconsistent:
        bars = clip_prices(bars)
    out = dedupe(bars.where(reason(minutes, rules).isNull()), rules.duplicates, row_no)
    out = out.select("symbol", "open_time", "close_time", *PRICES, "volume")
    return fill_gaps(out, minutes, rules.max_fill) if rules.max_fill else out


def gate(found: list[dict], complete: float, min_complete: float = 0.9, fail: bool = True) -> list[str]:
    """What forbids going on: faults that are errors, and too few of the calendar's bars. Raised unless fail is off."""
    bad = [f"{x['issue']}: {x['count']} rows" for x in found if x["severity"] == "ERROR"]
    if complete < min_complete:
        bad.append(f"completeness {complete:.3f} below {min_complete:.3f}")
    if bad and fail:
        raise DataQualityError(", ".join(bad))
    return bad

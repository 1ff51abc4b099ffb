"""Guarded rolling aggregates over the bars of a symbol. Missing values are null throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPS = 1e-12


def series():
    """The bars of a symbol in order of their close."""
    return W.partitionBy("symbol").orderBy("close_time")


def up_to_here():
    return series().rowsBetween(W.unboundedPreceding, 0)


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    """agg of the last n values where least of them, n by default, are there."""
    return F.when(F.count(c(x)).over(rows(n)) >= (n if least is None else least), agg(c(x)).over(rows(n)))


def mean(x, n, least=None):
    return rolling(F.avg, x, n, least)


def std(x, n):
    return rolling(F.stddev_pop, x, n)


def low(x, n):
    return rolling(F.min, x, n)


def high(x, n):
    return rolling(F.max, x, n)


def total(x, n):
    return rolling(F.sum, x, n)


def lag(x, k: int = 1) -> Column:
    return F.lag(c(x), k).over(series())


def zscore(x, n):
    return (c(x) - mean(x, n)) / (std(x, n) + EPS)


def rank_pct(x, n: int, least: int | None = None) -> Column:
    """Average-tie rank of the current value in its window, as a share."""
    least = max(20, n // 10) if least is None else least
    seen = F.collect_list(c(x)).over(rows(n))
    share = (F.size(F.filter(seen, lambda v: v < c(x))) + (F.size(F.filter(seen, lambda v: v == c(x))) + 1) / 2) / F.size(seen)
    return F.when(c(x).isNotNull() & (F.count(c(x)).over(rows(n)) >= least), share)


def linreg(y, n: int) -> tuple[Column, Column]:
    """Slope and r2 of y on the row number; a flat window has r2 0."""
    full, r = F.count(c(y)).over(rows(n)) == n, F.col("rn").cast("double")
    flat = F.max(c(y)).over(rows(n)) == F.min(c(y)).over(rows(n))
    return F.when(full, F.regr_slope(c(y), r).over(rows(n))), F.when(full & flat, 0.0).when(full, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.regr_r2(c(y), r).over(rows(n)))))


def flag(cond: Column) -> Column:
    """1.0 where cond holds, else 0.0; unknown counts as not."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def squash(x, scale: float = 1.0) -> Column:
    return F.tanh(F.greatest(c(x), F.lit(0.0)) / (scale + EPS))


def signed_squash(x, scale: float = 1.0) -> Column:
    return F.tanh(c(x) / (scale + EPS))


def safe_divide(a, b) -> Column:
    return c(a) / (F.abs(c(b)) + EPS)


def clip(x, a: float, b: float) -> Column:
    return F.when(c(x).isNotNull(), F.least(F.lit(b), F.greatest(F.lit(a), c(x))))


def numbered(df: DataFrame) -> DataFrame:
    """Adds rn, the bar's number within its symbol from 0 on."""
    return df.withColumn("rn", F.row_number().over(series()) - 1)

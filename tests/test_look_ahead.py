"""Plans that look ahead are told apart from those that do not."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.config import Config, Features, Frames
from barlake.functions import rolling as R
from barlake.operators import scan, zones
from barlake.operators.asof import asof
from barlake.operators.chunks import in_chunks
from barlake.plans import audit, catalogue
from barlake.sources.scratch import cut


@pytest.fixture(scope="module")
def bars(spark):
    b = catalogue.bars(spark, SMALL)
    return cut(b.where(F.dayofmonth("close_time") <= 6), b.columns)


def small(semantics="causal"):
    return Config(base_timeframe="15m", features=Features(semantics=semantics, mtf=Frames(timeframes=("1h",))))


def test_windows(bars):
    by = W.partitionBy("symbol")
    for name, column, wrong in (
        ("lead", F.lead("close", 2).over(R.series()), True), ("back", F.lag("close", -1).over(R.series()), True), ("all", F.max("close").over(by), True),
        ("rest", F.min("low").over(R.series().rowsBetween(0, W.unboundedFollowing)), True), ("next", F.avg("close").over(R.series().rowsBetween(-3, 1)), True), ("soon", F.avg("close").over(by.orderBy(F.unix_seconds("close_time")).rangeBetween(-60, 60)), True),
        ("late", F.sum("close").over(by.orderBy(F.desc("close_time")).rowsBetween(-5, 0)), True), ("inside", F.log(F.lead("close").over(R.series()) / F.col("close")), True),
        ("lag", F.lag("close", 3).over(R.series()), False), ("mean", R.mean("close", 20), False), ("so_far", F.max("high").over(R.up_to_here()), False), ("rank", F.row_number().over(R.series()), False),
    ):
        assert bool(audit.looks_ahead(bars.withColumn(name, column))) == wrong, name


def test_sums_joined_back(bars):
    sums = bars.groupBy("symbol").agg(F.avg("close").alias("usual"), F.count("*").alias("n"))
    back = "sum over a group joined back to its rows"
    assert audit.looks_ahead(bars.join(sums, "symbol")) == [("usual", back), ("n", back)]
    assert audit.looks_ahead(bars.join(sums.withColumn("twice", F.col("usual") * 2).select("symbol", "twice"), "symbol")) == [("twice", back)]
    assert audit.looks_ahead(bars.join(sums, "symbol", "left_semi")) == [] == audit.looks_ahead(sums)
    days = bars.groupBy("symbol", F.to_date("close_time").alias("day")).agg(F.max("high").alias("high"))
    same_day = bars.withColumn("day", F.to_date("close_time")).join(days.withColumnRenamed("high", "day_high"), ["symbol", "day"])
    assert audit.looks_ahead(same_day) == [("day_high", back)]
    w = W.partitionBy("symbol").orderBy("day")
    for end, wrong in ((-1, False), (0, True)):
        up_to = days.select("symbol", "day", F.max("high").over(w.rowsBetween(W.unboundedPreceding, end)).alias("top"))
        assert bool(audit.looks_ahead(bars.withColumn("day", F.to_date("close_time")).join(up_to, ["symbol", "day"]))) == wrong


def test_what_the_library_is_made_of(bars):
    assert audit.looks_ahead(scan.numbered(bars)) == []
    assert audit.looks_ahead(asof(bars, bars.select("symbol", "close_time", "close"), ["close"], strict=True, suffix="_before")) == []
    assert audit.looks_ahead(in_chunks(scan.numbered(bars), lambda d: d.withColumn("x", R.mean("close", 5)), 5, 50)) == []


def test_proof_of_the_matrix_and_of_planted_leaks(bars, monkeypatch):
    assert audit.proof(bars, small()) == []
    assert audit.proof(bars, small("reference")) == []
    monkeypatch.setattr(audit, "WHOLE_SERIES", frozenset())
    assert {x for x, _ in audit.proof(bars, small("reference"))} == {"_usual", "_labels"}
    honest = zones.features
    monkeypatch.setattr(zones, "features", lambda df, *a: honest(df, *a).withColumn("fvg_bull_age", F.max("fvg_bull_age").over(W.partitionBy("symbol"))))
    assert ("fvg_bull_age", "frame past the current row") in audit.proof(bars, small())

"""The replay audit: honest matrices pass in both semantics at six cutoffs, planted leaks are told by name."""

import pytest
from conftest import SMALL, against_oracle
from pyspark.sql import functions as F

from barlake.config import Config, Features, Frames
from barlake.functions import groups as G
from barlake.functions import rolling as R
from barlake.operators.asof import LeakageError
from barlake.plans import catalogue, engine


def hourly(semantics):
    """Base groups alone: the registered query audits coarse frames too."""
    return Config(base_timeframe="1h", features=Features(semantics=semantics, mtf=Frames(enabled=False, timeframes=("4h",))))


def test_planted_leak_equals_its_sql_on_more_bars(spark):
    against_oracle(spark, catalogue.QUERIES["replay_planted_leak"], catalogue.ORACLES["replay_planted_leak"], SMALL.replace("0.001", "0.01"))


def test_cutoffs(spark):
    bars = catalogue.bars(spark, SMALL, 60)
    span = bars.agg(F.min("close_time").cast("long").alias("a"), F.max("close_time").cast("long").alias("b")).first()
    found = engine.cutoffs_of(bars, 6)
    assert len(set(found)) == 6 and found == sorted(found) and found[-1] < span.b and found[0] > span.a + (span.b - span.a) // 4
    assert engine.cutoffs_of(bars.limit(0), 6) == []


@pytest.mark.parametrize("semantics", ["causal", "reference"])
def test_honest_matrix_has_no_difference(spark, semantics):
    bars = catalogue.bars(spark, SMALL, 60)
    assert engine.replay_audit(bars, hourly(semantics), 6).count() == 0


def test_planted_leak_in_the_matrix(spark, monkeypatch):
    honest = G.patterns
    monkeypatch.setattr(G, "patterns", lambda d: honest(d).withColumn("compression_strength", F.lead("close", 3).over(R.series())))
    with pytest.raises(LeakageError, match="compression_strength"):
        engine.replay_audit(catalogue.bars(spark, SMALL, 60), hourly("causal"), 6)

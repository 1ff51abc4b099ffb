"""Streams: late ticks are counted, and features from state equal those of the batch path over restarts."""

import datetime as dt
import math
import random
import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from barlake import bars as B
from barlake.calendars import Calendar
from barlake.functions import groups as G
from barlake.operators.zones import zones
from barlake.plans import catalogue
from barlake.streaming import features as S
from barlake.streaming import live

T0 = dt.datetime(2026, 1, 5)
SCHEMA = "event_id long, ts timestamp, value double"


@pytest.fixture
def rocks(spark):
    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in S.STATE_STORE:
        spark.conf.unset(k)


def finished(query):
    assert query.awaitTermination(240) and query.exception() is None
    return query


def test_late_ticks_are_counted(spark, tmp_path):
    listener = live.TickCounts()
    spark.streams.addListener(listener)
    root, at = f"file://{tmp_path}", lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[at(m) for m in range(0, 60)], [at(m) for m in range(60, 120)] + [at(2), at(3)], [at(m) for m in range(120, 180)], [at(181)] + [at(10 + k) for k in range(17)], [at(240)]]
    n = 0
    try:
        for batch in batches:
            rows = [(n + k, t, 1.0 + k) for k, t in enumerate(batch)]
            n += len(rows)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/ticks")
            ticks = spark.readStream.schema(SCHEMA).parquet(f"{root}/ticks")
            bars = live.observed_bars(ticks, 15, "10 minutes")
            query = finished(bars.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/bars"))
        told = spark.read.parquet(f"{root}/bars").agg(F.sum("volume")).first()[0]
        waiting = spark.read.format("statestore").load(f"{root}/checkpoint").agg(F.sum("value.count")).first()[0]
        for _ in range(100):
            if listener.sums.get(str(query.id), {}).get(live.TAKEN) == n:
                break
            time.sleep(0.1)
        sums = listener.sums[str(query.id)]
    finally:
        spark.streams.removeListener(listener)
    assert sums == {live.TAKEN: n, live.TOLD: told}
    late = live.late_ticks(spark, f"{root}/checkpoint", sums)
    assert late == n - told - waiting == 19


def test_features_from_state_equal_batch_over_restarts(spark, rocks, tmp_path):
    r, rows, price = random.Random(4), [], {"A": 100.0, "B": 50.0}
    for k in range(700):
        for s in price:
            if s == "B" and k % 3:
                continue
            o, price[s] = price[s], price[s] + r.gauss(0, 0.5) * (5 if r.random() < 0.05 else 1)
            c = price[s]
            t = T0 + dt.timedelta(minutes=5 * k if k < 400 else 5 * k + 4000)
            rows.append((s, t, t + dt.timedelta(minutes=5), o, max(o, c) + r.random() / 5, min(o, c) - r.random() / 5, c, 10.0))
    rows.append(("C", T0 + dt.timedelta(days=9), T0 + dt.timedelta(days=9, minutes=5), 1.0, 2.0, 0.5, 1.5, 1.0))
    every = spark.createDataFrame(rows, B.SCHEMA)
    cut = [T0 + dt.timedelta(minutes=5 * k if k < 400 else 5 * k + 4000) for k in (300, 420, 421, 600, 699)]
    until = lambda a, b: every.where((F.col("close_time") > F.lit(a)) & (F.col("close_time") <= F.lit(b)))
    history = every.where(F.col("close_time") <= F.lit(cut[0]))
    root = f"file://{tmp_path}"
    for parts in ([(cut[0], cut[1])], [(cut[1], cut[2]), (cut[1], cut[3])], [(cut[2], T0 + dt.timedelta(days=99))]):  # the second and third tell some bars again
        for a, b in parts:
            until(a, b).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(f"{root}/bars")
        stream = spark.readStream.schema(B.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars")
        finished(S.live_features(stream, history).writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/features"))
    got = spark.read.parquet(f"{root}/features")
    names = got.columns[2:]
    got = {(x.symbol, x.close_time): x for x in got.collect()}
    whole = zones(G.liquidity(G.structure(G.trend(G.shared(every).transform(lambda d: catalogue.classify(d)))), Calendar().trading_day))
    want = {(x.symbol, x.close_time): x for x in whole.where(F.col("close_time") > F.lit(cut[0])).select("symbol", "close_time", *names).collect()}
    assert got.keys() == want.keys() and len(names) > 60
    for k, w in want.items():
        for n in names:
            assert (got[k][n] is None) == (w[n] is None) and (w[n] is None or math.isclose(got[k][n], w[n], rel_tol=1e-6, abs_tol=1e-6)), (k, n, got[k][n], w[n])


def test_state_does_not_grow():
    s, r, sizes = S.Series(), random.Random(1), []
    for _ in range(6000):
        p = 100 + r.gauss(0, 3)
        s.step(p, p + 1, p - 1, p + 0.3)
        sizes.append(len(s.state()))
    assert max(sizes[4000:]) < 1.1 * max(sizes[500:2000])
    assert S.Series.resume(s.state()).state() == s.state()


def test_prime_takes_the_last_bars(spark):
    b = catalogue.bars(spark, SMALL)
    got = S.prime(b, 7)
    assert {r.close_time for r in got.collect()} == {r.close_time for r in b.orderBy(F.desc("close_time")).limit(7).collect()}


def test_replay_over_a_trimmed_buffer(spark):
    from barlake.config import Config, Features, Frames
    from barlake.plans.engine import transform

    cfg = Config(base_timeframe="15m", features=Features(max_warmup_bars=20, semantics="causal", mtf=Frames(timeframes=("1h",))))
    assert live.buffer_rows(cfg) > 1000
    bars = catalogue.bars(spark, SMALL).where(F.dayofmonth("close_time") <= 5)
    times = sorted(r.close_time for r in bars.select("close_time").collect())
    old = bars.where(F.col("close_time") < F.lit(times[-3]))
    batch, seen = bars.where(F.col("close_time") >= F.lit(times[-4])), {}
    sink = lambda rows, k: seen.setdefault(k, {r.close_time: r for r in rows.collect()})
    live.replay(cfg, lambda: old, sink)(batch, 0)
    want, made = transform(bars, cfg, drop_warmup=False)
    want = {r.close_time: r for r in want.where(F.col("close_time") >= F.lit(times[-3])).collect()}
    assert seen[0].keys() == want.keys() == set(times[-3:])
    for t, w in want.items():
        for n in made.names:
            assert (seen[0][t][n] is None) == (w[n] is None) and (w[n] is None or math.isclose(seen[0][t][n], w[n], rel_tol=1e-6, abs_tol=1e-6)), (t, n)
    live.replay(cfg, lambda: old, sink, keep=30)(batch.limit(0), 1)
    assert 1 not in seen

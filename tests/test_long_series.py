"""One long series in many tasks equals the plain plan and step-by-step code."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barlake.functions import groups as G
from barlake.operators import quality as Q
from barlake.operators import scan
from barlake.operators.chunks import in_chunks
from barlake.operators.zones import COLUMNS, states_in_chunks, zones
from barlake.plans.manifest import fvg, order_blocks
from barlake.sources.scratch import Steps

START = dt.datetime(2026, 1, 5)


def walk(n, seed=1, jump=0.06):
    """Bars of a random walk with jumps and pauses: (close_time, open, high, low, close)."""
    r, price, t, out = random.Random(seed), 100.0, START, []
    for _ in range(n):
        t += dt.timedelta(minutes=5 if r.random() > 0.02 else 5 * r.randint(2, 900))
        o = price + (r.gauss(0, 1.5) if r.random() < jump else 0)
        c = o + r.gauss(0, 0.4) * (4 if r.random() < jump else 1)
        out.append((t, o, max(o, c) + abs(r.gauss(0, 0.2)), min(o, c) - abs(r.gauss(0, 0.2)), c))
        price = c
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, t - dt.timedelta(minutes=5), t, *p, 10.0) for s, n in (("A", 900), ("B", 340), ("C", 1)) for t, *p in walk(n, len(s) + n)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double")


def values(df, *names):
    return {(r.symbol, r.close_time): tuple(r[n] for n in names) for r in df.select("symbol", "close_time", *names).collect()}


def same(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance)), (k, a[k], b[k])


def test_numbers_totals_and_last_values_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(s, START + dt.timedelta(minutes=k * k * 7), r.choice([None, None, None, float(k)])) for s in "ab" for k in range(160)]
    df = spark.createDataFrame(rows, "symbol string, close_time timestamp, x double").repartition(5)
    got = scan.numbered(df, 86400).withColumn(scan.BUCKET, scan.bucket("close_time", 86400))
    got = scan.carried(got, {"so_far": F.col("x"), "earlier": F.col("x")}, ["close_time"], strict=["earlier"])
    got = values(scan.totals(got, {"total": F.col("x")}, ["close_time"]), "rn", "so_far", "earlier", "total")
    for s in "ab":
        last, total = None, 0.0
        for k, (_, t, x) in enumerate(row for row in rows if row[0] == s):
            earlier, last, total = last, x if x is not None else last, total + (x or 0)
            assert got[s, t] == (k, last, earlier, total)


def test_empty_tables(spark, bars):
    none = bars.limit(0)
    assert scan.numbered(none).count() == 0
    assert G.structure(G.shared(none, 50), chunk_rows=50).count() == 0
    assert zones(G.shared(none, 50), 50).count() == 0


def test_chunks_equal_the_plain_plan(bars):
    p = {"atrs": (3, 5), "percentiles": (40,), "bb_rank": 30}
    trend = {"emas": (5, 12), "regressions": (20,), "hurst": 30}
    price = {"returns": (1, 7), "zscores": (20,)}
    whole, cut = G.shared(bars), G.shared(bars, 100)
    same(values(whole, "rn", "atr", "_c1"), values(cut, "rn", "atr", "_c1"))
    for group, step, p, names in (
        ("price", G.price, price, ("close_ret", "ret_7_atr", "zscore_close_20", "gap_atr")),
        ("volatility", G.volatility, p, ("atr_5", "atr_percentile_40", "vol_of_vol_50", "bb_width_percentile_30", "squeeze_flag", "vol_regime")),
        ("trend", G.trend, trend, ("dist_ema_12_atr", "ema_slope_5", "adx_14", "adx_slope_5", "macd_hist_atr", "rsi_14", "rsi_divergence_20", "linreg_slope_20_atr", "hurst_vr_30")),
        ("patterns", G.patterns, {}, ("double_retest_bull_strength", "breakout_bear_strength", "compression_strength", "momentum_bull_strength")),
    ):
        run = lambda d, step=step, p=p: step(d, **p)
        same(values(run(whole), *names), values(in_chunks(cut, run, G.reach(group, **p), 100), *names), 1e-7)


def test_structure_by_scans_equals_windows(bars):
    for rows in (7, 64, 5000):
        same(values(G.structure(G.shared(bars)), *G.STRUCTURE), values(G.structure(G.shared(bars), chunk_rows=rows), *G.STRUCTURE))


def test_no_window_spans_a_series(spark, bars):
    """Windows are dealt by symbol alone only over the short tables of buckets."""
    rows = [("A", t - dt.timedelta(minutes=5), t, *p, 1.0) for t, *p in walk(2000, 9)]
    one = spark.createDataFrame(rows, bars.schema)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        p = {"returns": (1, 7), "zscores": (20,)}
        out = in_chunks(G.shared(one, 100), lambda d: G.price(d, **p), G.reach("price", **p), 100)
        at = [r.task for r in out.withColumn("task", F.spark_partition_id()).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(set(at)) >= 6 and max(map(at.count, set(at))) < 1000


def zones_by_loop(bars, atrs, min_gap=0.15, age=288, gaps=3, push=1.0, blocks=2):
    """Zone columns of one series, both sides spelled out."""
    live = {"fvg_bull": [], "fvg_bear": [], "ob_bull": [], "ob_bear": []}
    out = []
    for i, ((_, o, h, lo, c), a) in enumerate(zip(bars, atrs, strict=True)):
        row = dict.fromkeys([n for n, _ in [*fvg(), *order_blocks()]], 0.0)
        out.append(row)
        if not a:
            continue
        if i >= 2:
            _, _, h2, lo2, _ = bars[i - 2]
            move = (c - bars[i - 1][4]) / a
            if lo - h2 > 0 and lo - h2 >= min_gap * a:
                live["fvg_bull"].append({"bottom": h2, "top": lo, "born": i, "low": lo, "high": h})
            if lo2 - h > 0 and lo2 - h >= min_gap * a:
                live["fvg_bear"].append({"bottom": h, "top": lo2, "born": i, "low": lo, "high": h})
            for side, far in (("bull", move >= push), ("bear", move <= -push)):
                against = [b for b in (bars[i - 1], bars[i - 2]) if (b[4] < b[1] if side == "bull" else b[4] > b[1])]
                if far and against:
                    gap = lo > h2 if side == "bull" else h < lo2
                    live[f"ob_{side}"].append({"bottom": against[0][3], "top": against[0][2], "born": i, "low": math.inf, "high": -math.inf, "move": abs(move), "gap": float(gap)})
        for kind, zone in live.items():
            bull = kind.endswith("bull")
            zone = [z for z in zone if i - z["born"] <= age]
            for z in zone:
                z["low"], z["high"] = min(z["low"], lo), max(z["high"], h)
            zone = [z for z in zone if (z["low"] > z["bottom"] if bull else z["high"] < z["top"])]
            zone.sort(key=lambda z: abs(c - (z["top"] if bull else z["bottom"])))  # noqa: B023
            live[kind] = zone = zone[: gaps if kind.startswith("fvg") else blocks]
            if kind.startswith("fvg"):
                row[f"fvg_count_{kind[4:]}"] = float(len(zone))
            if zone:
                z = zone[0]
                size, used = z["top"] - z["bottom"], (z["top"] - z["low"] if bull else z["high"] - z["bottom"])
                used, fresh = min(1.0, max(0.0, used / (size + 1e-12))), 1 - min(1.0, (i - z["born"]) / age)
                row |= {f"{kind}_exists": 1.0, f"{kind}_size_atr": size / a, f"{kind}_dist_atr": (c - z["top"] if bull else z["bottom"] - c) / a, f"{kind}_age": float(i - z["born"])}
                if kind.startswith("fvg"):
                    row |= {f"{kind}_fill_pct": used, f"{kind}_strength": math.tanh(size / a) * fresh * (1 - used)}
                else:
                    row |= {f"{kind}_mitigation_pct": used, f"{kind}_mitigated": float(used > 0), f"{kind}_strength": math.tanh(z["move"] / 2) * fresh * (1 - used)}
                    row["ob_confluence_fvg"] = max(row["ob_confluence_fvg"], z["gap"])
        n, m = row["fvg_count_bull"], row["fvg_count_bear"]
        row["fvg_imbalance"] = (n - m) / (n + m) if n + m else 0.0
    return out


@pytest.mark.parametrize("rows", [None, 23, 200, 5000])
def test_zones_equal_an_independent_loop(bars, rows):
    ready = G.shared(bars)
    names = [n for n, _ in [*fvg(), *order_blocks()]]
    got = values(zones(ready, rows), *names)
    by_symbol = {}
    for r in ready.orderBy("close_time").collect():
        by_symbol.setdefault(r.symbol, []).append(r)
    seen = 0
    for series in by_symbol.values():
        want = zones_by_loop([(r.close_time, r.open, r.high, r.low, r.close) for r in series], [r.atr for r in series])
        same({(r.symbol, r.close_time): got[r.symbol, r.close_time] for r in series}, {(r.symbol, r.close_time): tuple(w[n] for n in names) for r, w in zip(series, want, strict=True)})
        seen += sum(w["fvg_bull_exists"] + w["ob_bear_exists"] for w in want)
    assert seen > 100


def test_wrong_starts_are_done_again(bars):
    """Without bars before a chunk every guess is wrong, and rounds still end at the kernel's values."""
    ready = G.shared(bars)
    names = [c for c in COLUMNS if c.endswith(("exists", "count", "age"))]
    want = values(states_in_chunks(ready, 10_000, 0, Steps(bars.sparkSession)), *names)
    for rows, lead in ((50, 0), (50, 3), (200, 100)):
        steps = Steps(bars.sparkSession)
        same(values(states_in_chunks(ready, rows, lead, steps), *names), want)
        assert lead or len(steps.paths) > 3  # there were rounds
        steps.drop()
        assert steps.paths == []


def test_whole_matrix_in_chunks(bars):
    from barlake import config
    from barlake.plans.engine import transform

    cfg = config.Config(base_timeframe="5m", features=config.Features(max_warmup_bars=50, mtf=config.Frames(timeframes=("1h",))))
    plain, made = transform(bars.where("symbol = 'A'"), cfg)
    same(values(plain, *made.names), values(transform(bars.where("symbol = 'A'"), cfg, chunk_rows=300)[0], *made.names), 1e-6)


def test_medians_equal_numpy(spark):
    import numpy as np

    from barlake.operators.quality import medians

    r, rows = random.Random(8), []
    for key, n, make in (("a", 20_001, lambda: r.gauss(0, 1)), ("b", 20_000, lambda: r.choice([0.0, 0.0, 1.5, -2.0])), ("c", 1, lambda: 3.0), ("d", 2, r.random), ("e", 501, lambda: r.random() ** 9), ("f", 9, lambda: None)):
        rows += [(key, make()) for _ in range(n)]
    df = spark.createDataFrame(rows, "symbol string, x double").repartition(7)
    got = {x.symbol: (x.median, x.n) for x in medians(df, "x").collect()}
    for key in "abcde":
        values = [x for k, x in rows if k == key]
        assert got[key] == (pytest.approx(np.median(values), abs=1e-15), len(values))
    assert "f" not in got and medians(df.limit(0), "x").count() == 0


def test_extreme_returns_of_a_long_series(spark):
    import numpy as np

    from barlake.operators.quality import extreme_returns

    rows = [("A", t, o, h, lo, c, k) for k, (t, o, h, lo, c) in enumerate(walk(5000, 12, 0.01))]
    close = np.array([x[5] for x in rows])
    ret = np.diff(np.log(close))
    off = np.abs(ret - np.median(ret))
    want = {rows[k + 1][1] for k in np.flatnonzero(off / (1.4826 * np.median(off)) > 6)}
    df = spark.createDataFrame(rows, "symbol string, close_time timestamp, open double, high double, low double, close double, row_no long")
    assert {r.close_time for r in extreme_returns(df, 6.0, bucket_rows=333).collect()} == want and len(want) > 10


def test_issues_of_one_series_are_the_work_of_many_tasks(spark):
    """Counts over bucket seams equal those by hand, without a window over a whole series, and of rows without a symbol too."""
    rng = random.Random(5)
    rows = [(s, START + dt.timedelta(minutes=rng.choice((5, 5, 5, 6)) * rng.randrange(1, 120)), k * rng.choice((1, 3)) * 10 + j) for j, s in enumerate(("A", "B", None)) for k in range(1, 300)]
    rows += [("A", None, 10**6 + 1), ("A", START, 10**6 + 2), ("A", None, 10**6 + 3)]
    rows = list({(s, n): (s, t, n) for s, t, n in rows}.values())
    b = spark.createDataFrame([(s, t, 1.0, 2.0, 0.5, 1.5, 1.0, n) for s, t, n in rows], "symbol string, close_time timestamp, open double, high double, low double, close double, volume double, row_no long")
    back, copies = 0, len(rows) - len({(s, t) for s, t, _ in rows})
    for s in ("A", "B", None):
        times = [t for x, t, _ in sorted(rows, key=lambda r: r[2]) if x == s]
        back += sum(x is not None and y is not None and y < x for x, y in zip(times, times[1:]))
    for bucket_rows in (7, 100_000):
        got = {r.issue: r.n for r in Q.issues(b, 5, bucket_rows=bucket_rows).collect()}
        assert (got["non_monotonic"], got["duplicate_timestamp"]) == (back, copies) and back > 100
        m = Q.marked(b, 5, bucket_rows=bucket_rows)
        assert (m.where("non_monotonic").count(), m.where("duplicate_timestamp").count(), m.count()) == (back, copies, len(rows))
    assert {r.issue: r.n for r in Q.issues(b.limit(0), 5).collect()} == dict.fromkeys(Q.KINDS, 0)
    for df in (Q.issues(b, 5), Q.marked(b, 5)):
        assert "windowspecdefinition(symbol#" not in re.sub(r"windowspecdefinition\(symbol#\d+, close_time", "", df._jdf.queryExecution().optimizedPlan().toString())

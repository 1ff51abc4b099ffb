import datetime as dt
import json
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from barlake import bars as B
from barlake import config
from barlake.calendars import Calendar, classify
from barlake.functions import groups as G
from barlake.functions import rolling as R
from barlake.operators import quality as Q
from barlake.operators.asof import LeakageError, asof, verify
from barlake.operators.iir import ema, smooth, wilder
from barlake.operators.resample import resample
from barlake.operators.zones import COLUMNS, Tracker, zones
from barlake.plans import audit, catalogue, engine, manifest

# Bars and expected results made by hand, and instants of calendar and sessions, in the tests below.
T0 = dt.datetime(2026, 1, 6, 10, 0)


def frame(spark, rows, minutes=5, start=T0, symbol="ALL"):
    """Bars from (open, high, low, close[, volume]) rows."""
    step = dt.timedelta(minutes=minutes)
    data = [(symbol, start + i * step, start + (i + 1) * step, *map(float, r[:4]), float(r[4]) if len(r) > 4 else 100.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, B.SCHEMA)


def column(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy("close_time").select(*names).collect()]


def test_default_manifest_has_583_columns():
    made = manifest.build(config.Config())
    assert len(made.names) == 583 == len(set(made.names))
    assert made.warmup == 1200 and made.max_lookback == 28800
    assert manifest.Manifest.from_json(made.to_json()) == made
    with pytest.raises(manifest.FeatureError):
        made.assert_compatible(made.names[::-1])


def test_config_is_strict_and_hashes_alike(tmp_path):
    (tmp_path / "a.yaml").write_text("seed: 7\nfeatures: {price: {return_periods: [1, 2]}}\n")
    c = config.load([tmp_path / "a.yaml"], ["features.fvg.max_tracked=5"], {"BARLAKE_SEED": "9"})
    assert (c.seed, c.features.price.return_periods, c.features.fvg.max_tracked) == (9, (1, 2), 5)
    assert config.fingerprint(c.features) == config.fingerprint(c.features) != config.fingerprint(config.Features())
    with pytest.raises(config.ConfigError):
        config.load(overrides=["features.nope=1"])
    for bad in ("seed=x", "features.mtf.timeframes=[3m]", "data.source={path: a.csv, minutes: 15}", "data.validation.fail_on_error=1", "features.semantics=other"):
        with pytest.raises(ValueError):  # noqa: PT011
            config.load(overrides=[bad])
    some = config.load(overrides=["calendar.holidays=['2026-01-01']", "sessions.windows=[{name: NY, tz: America/New_York, start: '08:00', end: '17:00'}]", "data.cleaning.max_fill=3", "calendar.week_open=[0, '00:00']"])
    assert some.calendar.holidays == {"2026-01-01"} and some.sessions.windows[0].name == "NY" and some.data.cleaning.max_fill == 3 and some.calendar.week_open == (0, "00:00")
    assert config.build(config.Config, config.plain(some)) == some
    with pytest.raises(config.ConfigError):
        config.Config(base_timeframe="1h")


def test_known_values_of_primitives(spark):
    b = R.numbered(frame(spark, [(x, x, x, x) for x in (1, 1, 1, 5)]))
    out = smooth(b.withColumn("v", F.element_at(F.array(*map(F.lit, (2.0, 2.0, 2.0, 6.0))), (F.col("rn") + 1).cast("int"))), ema("e", "close", 3), wilder("w", "v", 3))
    assert column(out, "e")[2:] == [1.0, 3.0] and column(out, "w")[3] == pytest.approx(2 + 4 / 3)
    five = frame(spark, [(x, x, x, x) for x in (1, 2, 3, 4, 5)])
    assert column(five.select("close_time", R.mean("close", 3).alias("m")), "m") == [None, None, 2.0, 3.0, 4.0]
    ranks = frame(spark, [(x, x, x, x) for x in (1, 2, 2, 3, 2)])
    assert column(ranks.select("close_time", R.rank_pct("close", 5, 5).alias("r")), "r")[-1] == pytest.approx(0.6)


def test_smoothing_across_blocks_equals_a_loop(spark):
    rng = random.Random(5)
    x = [4000 + rng.gauss(0, 5) for _ in range(1500)]
    b = R.numbered(frame(spark, [(v, v, v, v) for v in x]))
    got = column(smooth(b, ema("a", "close", 200), ema("b", "close", 2)), "a", "b")
    y = z = x[0]
    for i, v in enumerate(x):
        if i:
            y, z = y + (v - y) * 2 / 201, z + (v - z) * 2 / 3
        assert (got[i][0] is None) == (i < 199)
        if i >= 199:
            assert got[i] == (pytest.approx(y, rel=1e-12), pytest.approx(z, rel=1e-12))


def test_resample_by_hand(spark):
    b = frame(spark, [(4000 + i, 4001 + i, 3999 + i, 4000.5 + i) for i in range(12)])
    first = resample(b, 5, 15).orderBy("close_time").first()
    assert (first.open, first.high, first.low, first.close, first.volume, first.n_base_bars) == (4000, 4003, 3999, 4002.5, 300, 3)
    assert resample(b.where("open < 4011"), 5, 15).count() == 3
    with pytest.raises(B.ResampleError):
        resample(b, 15, 5)


def test_coarse_bar_is_seen_from_its_close_on(spark):
    b = frame(spark, [(i, 400 if i == 4 else i, i, i) for i in range(1, 7)])
    coarse = resample(b, 5, 15)
    out = asof(b, coarse, ["high"], suffix="_15m", matched="at")
    assert column(verify(out, "at"), "high_15m") == [None, None, 3.0, 3.0, 3.0, 400.0]
    with pytest.raises(LeakageError):
        verify(out.withColumn("at", F.col("close_time") + F.expr("INTERVAL 1 MINUTE")), "at")


def test_calendar_and_sessions_follow_daylight_saving(spark):
    def at(s):
        return spark.createDataFrame([(s,)], "s string").select(F.col("s").cast("timestamp").alias("close_time"))

    c = Calendar()
    for s, want in (("2026-01-10 12:00", False), ("2026-01-11 22:30", False), ("2026-01-11 23:30", True), ("2026-01-09 21:30", True), ("2026-01-07 22:30", False), ("2026-07-08 21:30", False), ("2026-07-08 22:30", True)):
        assert at(s).select(c.is_open(F.col("close_time"))).first()[0] is want, s
    for s, want in (("2026-01-12 22:30", "2026-01-12"), ("2026-01-12 23:30", "2026-01-13")):
        assert str(at(s).select(c.trading_day(F.col("close_time"))).first()[0]) == want
    for s, want in (("2026-07-15 12:30", "LONDON_NY_OVERLAP"), ("2026-01-15 12:30", "LONDON"), ("2026-01-15 02:00", "ASIA"), ("2026-01-15 23:00", "OFF")):
        assert classify(at(s)).first().session == want


def test_swing_is_seen_late(spark):
    high = [10, 11, 12, 13, 20, 13, 12, 11, 10, 9, 8]
    b = G.shared(frame(spark, [(h - 1, h, h - 2, h - 1) for h in high])).withColumn("atr", F.lit(1.0))
    got = column(G.structure(b), "swing_high_flag", "last_swing_high_age")
    assert [x[0] for x in got[4:7]] == [0.0, 0.0, 1.0] and got[6][1] == 2.0


def test_zones_by_hand(spark):
    rows = list(zip((9.5, 11, 12.5, 13, 13), (10, 14, 16, 16.5, 16.5), (9, 10.5, 12, 12.5, 12.5), (9.8, 13, 15, 15, 15), strict=True))
    b = G.shared(frame(spark, rows)).withColumn("atr", F.lit(1.0))
    got = column(zones(b), "fvg_bull_exists", "fvg_bull_size_atr")
    assert [x[0] for x in got[:3]] == [0.0, 0.0, 1.0] and got[2][1] == 2.0


def test_zone_tracker_mirrors(spark):
    rng = random.Random(3)
    up, down, p = Tracker(), Tracker(), 100.0
    for _ in range(600):
        o, p = p, p + rng.gauss(0, 1.5)
        h, lo = max(o, p) + rng.random(), min(o, p) - rng.random()
        a, b = dict(zip(COLUMNS, up.step((o, h, lo, p), 1.0), strict=True)), dict(zip(COLUMNS, down.step((-o, -lo, -h, -p), 1.0), strict=True))
        assert all(a[k] == pytest.approx(b[k.replace("bull", "#").replace("bear", "bull").replace("#", "bear")]) for k in a)


def test_cleaning_and_gate(spark):
    b = frame(spark, [(1, 2, 0.5, 1.5)] * 3 + [(1, 0.5, 2, 1.5)]).withColumn("row_no", F.monotonically_increasing_id())
    twice = b.unionByName(b.limit(1).withColumn("row_no", F.lit(10**6).cast("long")))
    assert Q.clean(twice, 5).count() == 3
    assert {r.issue: r.n for r in Q.issues(twice, 5).collect()}["duplicate_timestamp"] == 1
    assert Q.fill_gaps(frame(spark, [(1, 2, 0.5, 1.5)]).unionByName(frame(spark, [(1, 2, 0.5, 1.5)], start=T0 + dt.timedelta(minutes=20))), 5, 3).count() == 5
    with pytest.raises(B.DataQualityError, match="ohlc_inconsistent"):
        Q.gate(Q.findings(twice, 5), 1.0)
    assert Q.gate([], 0.5, fail=False) and not Q.gate([], 0.95)
    nulls = frame(spark, [(1, 2, 0.5, 1.5)] * 200).withColumn("row_no", F.monotonically_increasing_id()).withColumn("close", F.when(F.minute("close_time") != 5, F.col("close")))
    found = {x["issue"]: x for x in Q.findings(nulls, 5)}
    assert found["null_value"]["severity"] == "ERROR" and len(found["null_value"]["examples"]) == 3 and found["null_value"]["share"] == found["null_value"]["count"] / 200
    assert {x["issue"]: x for x in Q.findings(nulls, 5, max_null=0.5)}["null_value"]["severity"] == "WARNING"
    with pytest.raises(B.SchemaError):
        B.check(twice, 5)


def test_stores(spark, tmp_path):
    from barlake.sources import stores

    b, root = frame(spark, [(1, 2, 0.5, 1.5)] * 20), f"file://{tmp_path}/bars"
    stores.write_bars(b, root, "5m")
    stores.write_bars(b.limit(1).withColumn("close", F.lit(9.0)), root, "5m", overwrite=False)
    back = stores.read_bars(spark, root, "ALL", "5m")
    assert back.count() == 20 and back.where("close = 9").count() == 1
    assert stores.store_summary(spark, root).first().n_rows == 20
    with pytest.raises(stores.StorageError):
        stores.read_bars(spark, root, "NONE", "5m")
    (tmp_path / "file").write_text("no folder")
    with pytest.raises(Exception) as e:  # noqa: PT011
        stores.write_bars(b, f"file://{tmp_path}/file/bars", "5m", overwrite=False)
    assert not isinstance(e.value, stores.NoStore)


def test_csv_dialects(spark, tmp_path):
    from barlake.sources.csv_bars import CsvSource, digest, load

    cases = {
        "iso.csv": ("datetime,open,high,low,close,volume\n2026-01-05 10:00:00,1,2,0.5,1.5,7\n", {}),
        "mt5.csv": ("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2026.01.05\t10:00:00\t1\t2\t0.5\t1.5\t7\n", {"date_column": "DATE", "time_column": "TIME"}),
        "eu.csv": ("datetime;open;high;low;close;volume\n2026-01-05 10:00:00;1,0;2,0;0,5;1,5;7\n", {"decimal": ","}),
    }
    for name, (text, options) in cases.items():
        (tmp_path / name).write_text(text)
        r = load(spark, CsvSource(f"file://{tmp_path}/{name}", 5, **options)).first()
        assert (r.open, r.high, r.low, r.close, r.volume, str(r.close_time)) == (1.0, 2.0, 0.5, 1.5, 7.0, "2026-01-05 10:05:00"), name
    (tmp_path / "bad.csv").write_text("datetime,open,high\n2026-01-05 10:00:00,1,2\n")
    with pytest.raises(B.SchemaError):
        load(spark, CsvSource(f"file://{tmp_path}/bad.csv", 5))
    import hashlib

    assert digest(spark, f"file://{tmp_path}/bad.csv") == hashlib.sha256((tmp_path / "bad.csv").read_bytes()).hexdigest()
    quoted = 'note\n"datetime","open","high","low","close","volume","x"\n"2026-01-05 10:00:00","1","2","0.5","1.5","7","a,b"\nnote\n'.replace("\nnote\n", "\n2026-01-05 10:05:00,1,2,0.5,1.5,7,note\n")
    (tmp_path / "quoted.csv").write_text(quoted)
    got = load(spark, CsvSource(f"file://{tmp_path}/quoted.csv", 5, skip_rows=1, delimiter=",")).orderBy("row_no").collect()
    assert [(str(r.open_time), r.volume) for r in got] == [("2026-01-05 10:00:00", 7.0), ("2026-01-05 10:05:00", 7.0)]


def test_repeated_local_hours_across_splits(spark, tmp_path):
    from barlake.sources.csv_bars import CsvSource, load

    # Clocks go back in London on 2026-10-25 at 01:00 UTC: 01:00 to 01:55 local time comes twice.
    utc = [dt.datetime(2026, 10, 24, 23, 0) + k * dt.timedelta(minutes=5) for k in range(60)]
    local = [t + dt.timedelta(hours=1) if t < dt.datetime(2026, 10, 25, 1, 0) else t for t in utc]
    (tmp_path / "local.csv").write_text("datetime,open,high,low,close,volume\n" + "".join(f"{t:%Y-%m-%d %H:%M:%S},1,2,0.5,1.5,7\n" for t in local))
    for size in ("128m", "1200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = load(spark, CsvSource(f"file://{tmp_path}/local.csv", 5, source_tz="Europe/London")).orderBy("row_no").collect()
        assert [r.open_time for r in got] == utc
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_engine_writes_and_reads_back(spark, tmp_path):
    from barlake.sources import stores

    cfg = config.Config(base_timeframe="15m", features=config.Features(max_warmup_bars=100, mtf=config.Frames(timeframes=("1h",))))
    matrix, made = engine.transform(catalogue.bars(spark, SMALL), cfg)
    matrix = engine.cut(matrix, matrix.columns)
    assert matrix.columns == ["symbol", "close_time", *made.names] and matrix.count() > 0
    root = f"file://{tmp_path}/features"
    stores.write_features(matrix, made, root)
    assert stores.read_features(spark, root, made.version, "ALL").count() == matrix.count()
    listed = stores.list_feature_sets(spark, root).first()
    assert (listed.n_features, listed.n_rows) == (len(made.names), matrix.count()) and listed.created_at
    middle = matrix.selectExpr("percentile_approx(unix_seconds(close_time), 0.5)").first()[0]
    day = dt.datetime.fromtimestamp(middle, dt.UTC).strftime("%Y-%m-%d")
    assert stores.read_features(spark, root, made.version, "ALL", start=day).count() == matrix.where(F.col("close_time") >= day).count()
    assert json.loads(stores.read_manifest(spark, root, made.version).to_json())["version"] == made.version


def test_nothing_looks_ahead(spark):
    from pathlib import Path

    allowed = frozenset({"quality.py"})  # filling gaps between stored bars is repair, not a feature
    assert audit.scan_source(Path(engine.__file__).parent.parent / "functions", allowed) == []
    bad = frame(spark, [(1, 2, 0.5, 1.5)] * 3).withColumn("x", F.lead("close").over(R.series()))
    assert audit.looks_ahead(bad) == [("x", "frame past the current row")]


def test_stream_equals_batch_on_closed_bars(spark, tmp_path):
    from barlake.streaming.live import stream_bars

    e = catalogue.events(spark, SMALL)
    e.repartition(1).sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/ticks")
    ticks = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/ticks")
    q = stream_bars(ticks, 15).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = B.ticks_to_bars(e, 15)
    cols = ["close_time", "open", "high", "low", "close", "volume"]
    got = {tuple(r) for r in spark.table("live").select(*cols).collect()}
    want = {tuple(r) for r in batch.select(*cols).collect()}
    assert got <= want and len(want - got) <= 2


def bars_csv(path, n=2000, drop=range(0), **bad):
    """Random-walk bars on the calendar's 5-minute grid from 2026-01-05 on; bad maps a column to (row, value)."""
    rng, price, rows, t = random.Random(7), 4000.0, [], dt.datetime(2026, 1, 5)
    while len(rows) < n:
        local = t - dt.timedelta(hours=5)  # New York in winter
        minute = local.weekday() * 1440 + local.hour * 60 + local.minute
        if (minute >= 6 * 1440 + 1080 or minute < 4 * 1440 + 1020) and not (local.hour == 17 and local.weekday() not in (6, 4)):
            o, price = price, price + rng.gauss(0, 2)
            rows.append({"datetime": t, "open": o, "high": max(o, price) + rng.random(), "low": min(o, price) - rng.random(), "close": price, "volume": rng.randrange(50, 2000)})
        t += dt.timedelta(minutes=5)
    for column, (k, value) in bad.items():
        rows[k][column] = value
    rows = [r for k, r in enumerate(rows) if k not in drop]
    path.write_text(",".join(rows[0]) + "\n" + "".join(",".join(map(str, r.values())) + "\n" for r in rows))
    return f"file://{path}"


def test_ingest_from_file_to_stores(spark, tmp_path):
    from barlake.plans.ingest import ingest, stored
    from barlake.sources import stores

    path = bars_csv(tmp_path / "bars.csv")
    cfg = config.load(overrides=[f"data.source.path={path}", f"data_root=file://{tmp_path}/data"], env={})
    looked = ingest(spark, cfg, persist=False, hash_source=False)
    assert looked.written == [] and not (tmp_path / "data").exists()
    done = ingest(spark, cfg)
    assert list(done.bars) == ["5m", "15m", "1h", "4h", "1d"] and done.report["rows_out"] == done.bars["5m"].count() == 2000
    assert done.report["completeness"] == 1.0 and len(done.report["source_sha256"]) == 64 and not done.report["problems"]
    end = done.bars["5m"].agg(F.max("close_time")).first()[0]
    assert all(d.agg(F.max("close_time")).first()[0] <= end for d in done.bars.values())
    base, frames = stored(spark, cfg)
    assert column(base, "close_time", "close") == column(done.bars["5m"], "close_time", "close") and set(frames) == {"15m", "1h", "4h", "1d"}
    assert {r.tf for r in stores.store_summary(spark, cfg.store("resampled")).collect()} == set(frames)
    assert stores.read_report(spark, done.written[-1]) == json.loads(json.dumps(done.report))


def test_ingest_refuses_bad_data(spark, tmp_path):
    from barlake.plans.ingest import ingest

    for name, options, said in (("bad", {"close": (100, -5.0)}, "non_positive_price"), ("gaps", {"drop": range(500, 1200)}, "completeness")):
        path = bars_csv(tmp_path / f"{name}.csv", **options)
        sets = [f"data.source.path={path}", "data.validation.min_completeness=0.95", "data.context_timeframes=[1h]"]
        with pytest.raises(B.DataQualityError, match=said):
            ingest(spark, config.load(overrides=sets, env={}), persist=False, hash_source=False)
        warned = ingest(spark, config.load(overrides=[*sets, "data.validation.fail_on_error=false"], env={}), persist=False, hash_source=False)
        assert said in warned.report["problems"][0]
    assert warned.report["missing_bars"] == 700 and sum(g["bars"] for g in warned.report["gaps"]) == 700


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from barlake.__main__ import main

    path = bars_csv(tmp_path / "bars.csv", 900)
    (tmp_path / "c.yaml").write_text(f"data_root: file://{tmp_path}/data\nartifact_root: file://{tmp_path}/out\ndata: {{source: {{path: '{path}'}}, context_timeframes: [1h]}}\nfeatures: {{max_warmup_bars: 50, mtf: {{timeframes: [1h]}}}}\n")
    run = lambda *words: main([*words, "--config", str(tmp_path / "c.yaml")], spark)
    assert main(["version"], spark) == 0 and main(["config-show", "--set", "seed=x"], spark) == 1
    assert run("config-show") == 0 and "fingerprint" in capsys.readouterr().out
    assert run("data", "summary") == 1
    assert run("data", "ingest") == 0 and run("data", "summary") == 0
    assert "ALL\t5m\t900" in capsys.readouterr().out
    assert run("features", "build", "--cutoffs", "1") == 0 and run("features", "list") == 0
    assert "fs_" in capsys.readouterr().out
    from barlake.functions import groups as G

    honest = G.patterns
    monkeypatch.setattr(G, "patterns", lambda d: honest(d).withColumn("compression_strength", F.lead("close", 3).over(R.series())))
    assert run("features", "audit", "--cutoffs", "1") == 2

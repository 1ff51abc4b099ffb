"""From a CSV file to stored bars: load, find faults, clean, look for gaps, decide, resample, store, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.bars import check
from barlake.config import Config, fingerprint
from barlake.operators import quality
from barlake.operators.resample import resample
from barlake.plans.engine import cut
from barlake.sources import stores
from barlake.sources.csv_bars import digest, load
from barlake.timeframes import Timeframe


@dataclass(frozen=True)
class Ingested:
    """Bars by timeframe, the base first, and the report; written are the folders that hold them now."""

    bars: dict[str, DataFrame]
    report: dict
    written: list[str] = field(default_factory=list)


def report_of(raw: DataFrame, base: DataFrame, cfg: Config) -> dict:
    """What is wrong with the bars as loaded, and what the cleaned ones lack."""
    v, minutes = cfg.data.validation, Timeframe(cfg.base_timeframe).minutes
    found = quality.findings(raw, minutes, v.extreme_return_sigma, v.max_null_fraction, v.flag_zero_volume)
    dropped = raw.groupBy(quality.reason(minutes, cfg.data.cleaning).alias("reason")).count().where("reason IS NOT NULL").collect()
    span = base.agg(F.count("*").alias("n"), F.min("close_time").alias("start"), F.max("close_time").alias("end")).first()
    gaps = quality.gap_runs(base, minutes, cfg.calendar, v.max_gap_bars_reported).collect()
    whole = quality.completeness(base, minutes, cfg.calendar).first()
    return {
        "symbol": cfg.symbol, "timeframe": cfg.base_timeframe, "source": cfg.data.source.path, "config": fingerprint(cfg),
        "rows_in": raw.count(), "rows_out": span.n, "start": str(span.start), "end": str(span.end), "issues": found, "dropped": {r.reason: r["count"] for r in dropped},
        "expected_bars": whole.expected if whole else 0, "missing_bars": whole.missing if whole else 0, "completeness": whole.completeness if whole else 0.0,
        "gaps": [{"start": str(g.gap_start), "end": str(g.gap_end), "bars": g.n_bars} for g in gaps],
    }


def ingest(spark: SparkSession, cfg: Config, persist: bool = True, hash_source: bool = True) -> Ingested:
    """Bars of cfg.data.source and their coarser frames, stored under cfg.data_root unless persist is off.

    Faults are those of the bars as loaded: a row that cleaning drops still counts against them. DataQualityError is
    raised if they, or the share of the calendar's bars that is there, forbid going on and validation.fail_on_error is set.
    """
    minutes, r = Timeframe(cfg.base_timeframe).minutes, cfg.data.resample
    loaded = load(spark, cfg.data.source).withColumn("symbol", F.lit(cfg.symbol))
    raw = cut(loaded, loaded.columns)
    cleaned = quality.clean(raw, minutes, cfg.data.cleaning)
    base = check(cut(cleaned, cleaned.columns), minutes)
    report = report_of(raw, base, cfg)
    if hash_source:
        report["source_sha256"] = digest(spark, cfg.data.source.path)
    report["problems"] = quality.gate(report["issues"], report["completeness"], cfg.data.validation.min_completeness, cfg.data.validation.fail_on_error)
    coarse = {
        tf: resample(base, minutes, Timeframe(tf).minutes, cfg.calendar, r.h4_anchor_offset_minutes if tf == "4h" else 0, r.daily_anchor_tz, r.daily_anchor_time, r.min_bars_for_complete, r.drop_incomplete_last_bar)
        for tf in cfg.data.context_timeframes
    }
    bars = {cfg.base_timeframe: base, **{tf: cut(d, d.columns) for tf, d in coarse.items()}}
    written = []
    if persist:
        for tf, d in bars.items():
            root = cfg.store("bars" if tf == cfg.base_timeframe else "resampled")
            stores.write_bars(d, root, tf)
            written.append(f"{root}/symbol={cfg.symbol}/tf={tf}")
        path = f"{cfg.store('reports')}/quality_{cfg.symbol}_{cfg.base_timeframe}"
        stores.write_report(spark, path, report)
        written.append(path)
    return Ingested(bars, report, written)


def stored(spark: SparkSession, cfg: Config) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Base bars and the coarse frames of cfg.features from the stores that ingest() wrote."""
    base = stores.read_bars(spark, cfg.store("bars"), cfg.symbol, cfg.base_timeframe)
    frames = cfg.features.mtf.timeframes if cfg.features.mtf.enabled else ()
    return base, {tf: stores.read_bars(spark, cfg.store("resampled"), cfg.symbol, tf) for tf in frames}

"""The feature matrix: groups over base bars, coarse frames joined as of each close, running and cross features."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.calendars import Calendar, classify
from barlake.config import Config
from barlake.functions import groups as G
from barlake.operators.asof import LeakageError, asof_many, verify
from barlake.operators.chunks import in_chunks
from barlake.operators.resample import resample
from barlake.operators.zones import zones
from barlake.plans import manifest as M
from barlake.sources.scratch import cut
from barlake.timeframes import Timeframe

#: Columns of time that look at a whole series by the definition of reference semantics.
LOOKS_AHEAD = ("session_progress", "is_session_last_hour", "session_atr_ratio")

BARS = ["symbol", "open_time", "close_time", "open", "high", "low", "close", "volume"]


def cut_all(makers: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """cut() of several frames that are planned and written beside each other: planning, and few tasks, leave cores idle."""
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return list(pool.map(lambda make: cut(d := make(), d.columns), makers))


def grouped(ready: DataFrame, steps: dict, names: dict[str, list[str]]) -> DataFrame:
    """ready with the columns of each step: one plan over one partitioning by symbol, without joins between the groups."""
    core, made = ready.columns, []
    for g, step in steps.items():
        made += names[g]
        ready = step(ready).select(*core, *made)
    return ready


def base_groups(bars: DataFrame, cfg: Config, calendar: Calendar = Calendar(), frames: tuple[str, ...] = (), chunk_rows: int | None = None) -> tuple[DataFrame, list[Callable[[], DataFrame]]]:
    """bars with atr and rn, and what makes each enabled base group and the bars in progress of the coarse frames.

    With chunk_rows the groups of bounded reach are worked out in chunks of so many rows of a series."""
    f, tf = cfg.features, Timeframe(cfg.base_timeframe)
    p = M.parameters(f, False, tf.bars_per_day)
    causal = f.semantics == "causal"
    ready = classify(G.shared(bars.select(*BARS), chunk_rows), causal=causal)
    ready = cut(ready, ready.columns)
    zone = {"min_gap": f.fvg.min_size_atr, "gap_age": f.fvg.max_age_bars, "gaps": f.fvg.max_tracked, "displacement": f.order_blocks.displacement_atr, "block_age": f.order_blocks.max_age_bars, "blocks": f.order_blocks.max_tracked}
    steps = {
        "price": lambda d: G.price(d, p["returns"], p["zscores"]),
        "volatility": lambda d: G.volatility(d, p["atrs"], p["percentiles"], bb_rank=p["bb_rank"], bars_per_day=tf.bars_per_day),
        "volume": lambda d: G.volume(d, days=f.volume.time_of_day_days),
        "trend": lambda d: G.trend(d, p["emas"], p["regressions"], p["hurst"]),
        "structure": lambda d: G.structure(d, p["k"], p["memory"], p["span"], chunk_rows),
        "patterns": G.patterns,
        "time": lambda d: G.clock(d, tf.minutes, f.time.session_vol_days, f.gap_flag_bars, causal),
        "liquidity": lambda d: G.liquidity(d, calendar.trading_day, f.liquidity.sweep_lookback, f.liquidity.sweep_tolerance_atr, f.liquidity.level_cluster_atr),
    }
    names = {g: [n for n, _ in M.BASE[g](**p)] for g in M.BASE}
    # Groups that need the bars alone are split so that no plan grows too wide to compile; each part reads ready again.
    parts = (("price", "volatility", "volume"), ("trend", "structure", "patterns"), ("time",), ("liquidity",))
    if chunk_rows:
        parts = (("price", "volatility"), ("volume",), ("trend", "patterns"), ("structure",), ("time",), ("liquidity",))
    parts = [[g for g in part if getattr(f, g).enabled] for part in parts]

    def made(part: list[str]) -> DataFrame:
        look = [G.reach(g, **p) for g in part]
        step = lambda d: grouped(d, {g: steps[g] for g in part}, names)
        return in_chunks(ready, step, max(look), chunk_rows) if chunk_rows and None not in look else step(ready)

    def maker(make: Callable[[], DataFrame], new: list[str]) -> Callable[[], DataFrame]:
        return lambda: make().select("symbol", "close_time", *new)

    makers = [maker(lambda part=part: made(part), [n for g in part for n in names[g]]) for part in parts if part]
    if f.fvg.enabled or f.order_blocks.enabled:
        makers.append(maker(lambda: zones(ready, chunk_rows, **zone), [n for g in ("fvg", "order_blocks") if getattr(f, g).enabled for n in names[g]]))
    if f.mtf.enabled and f.mtf.include_running_position and frames:
        finer = [tf for tf in frames if tf != "1d"]
        makers.append(maker(lambda: G.running(ready, tf.minutes, [Timeframe(x).minutes for x in finer]), [f"running_{n}_{x}" for x in finer for n in M.RUNNING]))
    return ready, makers


def coarse_names(cfg: Config, tf: str) -> dict[str, list[str]]:
    """The columns of each coarse group of a frame."""
    p = M.parameters(cfg.features, True, Timeframe(tf).bars_per_day)
    return {g: [n for n, _ in M.BASE[g](**p)] for g in M.COARSE if g in cfg.features.mtf.groups}


def coarse_groups(bars: DataFrame, cfg: Config, tf: str) -> DataFrame:
    per_day = Timeframe(tf).bars_per_day
    p, names = M.parameters(cfg.features, True, per_day), coarse_names(cfg, tf)
    steps = {
        "price": lambda d: G.price(d, p["returns"], p["zscores"]), "volatility": lambda d: G.volatility(d, p["atrs"], p["percentiles"], bb_rank=p["bb_rank"], bars_per_day=per_day),
        "trend": lambda d: G.trend(d, p["emas"], p["regressions"], p["hurst"]), "structure": lambda d: G.structure(d, p["k"], p["memory"], p["span"]),
    }
    out = grouped(G.shared(bars.select(*BARS)), {g: steps[g] for g in names}, names)
    return out.select("symbol", "close_time", *(n for g in names for n in names[g]))


def transform(bars: DataFrame, cfg: Config, context: dict[str, DataFrame] | None = None, drop_warmup: bool = True, calendar: Calendar = Calendar(), chunk_rows: int | None = None) -> tuple[DataFrame, M.Manifest]:
    """(matrix, manifest). context has closed coarse bars by timeframe; without it they are resampled from bars. chunk_rows
    makes one long series the work of many tasks, at the price of the rows that chunks share."""
    f, base = cfg.features, Timeframe(cfg.base_timeframe)
    bars = cut(bars, BARS)
    if context is None:
        context = {tf: resample(bars, base.minutes, Timeframe(tf).minutes) for tf in f.mtf.timeframes} if f.mtf.enabled else {}
    context = {tf: context[tf] for tf in f.mtf.timeframes if tf in context}
    out, makers = base_groups(bars, cfg, calendar, tuple(context), chunk_rows)
    written = cut_all([*makers, *(lambda tf=tf, frame=frame: coarse_groups(frame, cfg, tf) for tf, frame in context.items())])
    for d in written[: len(makers)]:
        out = out.join(d, ["symbol", "close_time"])
    coarse = {tf: (d, d.columns[2:]) for tf, d in zip(context, written[len(makers) :], strict=True)}
    if context:
        own = out.columns
        out = asof_many(out, {f"_{tf}": pair for tf, pair in coarse.items()})
        out = out.select(*own, *(F.col(f"_{tf}.{n}").alias(f"{n}_{tf}") for tf in context for n in coarse[tf][1]), F.greatest(*(F.col(f"_{tf}._at") for tf in context), F.lit(None).cast("timestamp")).alias("_matched"))
        out = G.cross(out, {tf: Timeframe(tf).minutes for tf in context})
    made = M.build(cfg, list(context))
    if drop_warmup:
        size = bars.groupBy("symbol").agg(F.count("*").alias("_size"))
        out = out.join(size, "symbol").where((F.col("rn") >= made.warmup) | (F.col("_size") <= made.warmup))
    kept = [F.col(n).cast("double").alias(n) for n in made.names]
    if context:
        return verify(cut(out, ["symbol", "close_time", *kept, "_matched"]), "_matched").drop("_matched"), made
    return out.select("symbol", "close_time", *kept), made


def null_report(matrix: DataFrame) -> DataFrame:
    """(feature, null_share), the largest first."""
    names = [c for c in matrix.columns if c not in ("symbol", "close_time")]
    one = matrix.agg(*(F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names))
    return one.unpivot([], names, "feature", "null_share").orderBy(F.desc("null_share"), "feature")


def dead_columns(matrix: DataFrame) -> DataFrame:
    """Columns that are all null or constant."""
    names = [c for c in matrix.columns if c not in ("symbol", "close_time")]
    low, high = (matrix.agg(*(f(n).alias(n) for n in names)).unpivot([], names, "feature", v) for f, v in ((F.min, "low"), (F.max, "high")))
    return low.join(high, "feature").where("low IS NULL OR low = high").select("feature", F.when(F.col("low").isNull(), "null").otherwise("constant").alias("kind"))


def cutoffs_of(bars: DataFrame, n: int) -> list[int]:
    """n moments, in seconds: the middles of n equal parts of the last three quarters of the time that bars take up."""
    t = F.col("close_time").cast("long")
    span = bars.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    return [] if span.a is None else [span.a + (span.b - span.a) * (2 * n + 6 * k - 3) // (8 * n) for k in range(1, n + 1)]


def replay_differences(bars: DataFrame, make: Callable[[DataFrame], DataFrame], cutoffs: list[int], rtol: float = 1e-8, atol: float = 1e-8) -> DataFrame:
    """(cutoff, symbol, close_time, feature, full, replayed): values at a symbol's last close up to a cutoff that are others
    once the bars after the cutoff are taken away. Both null are equal.

    make tells symbol, close_time and features of bars, each symbol by itself. The bars up to each cutoff are a symbol of
    their own, so that all cutoffs are one plan, worked out beside each other.
    """
    t = F.col("close_time").cast("long")
    copies = bars.withColumn("cutoff", F.explode(F.array(*(F.lit(x).cast("long") for x in cutoffs)))).where(t <= F.col("cutoff"))
    copies = copies.withColumn("copy", F.concat_ws("\n", "symbol", F.col("cutoff").cast("string")))
    ends = copies.groupBy("symbol", "cutoff", "copy").agg(F.max("close_time").alias("close_time"))
    ends = cut(ends, ends.columns)
    whole, part = make(bars), make(copies.withColumn("symbol", F.col("copy")).drop("cutoff", "copy"))
    names = [c for c in whole.columns if c not in ("symbol", "close_time")]

    def long(d: DataFrame, value: str) -> DataFrame:
        return d.unpivot(["cutoff", "symbol", "close_time"], names, "feature", value)

    full = long(whole.join(ends.drop("copy"), ["symbol", "close_time"]), "full")
    again = part.withColumnRenamed("symbol", "copy").join(ends, ["copy", "close_time"])
    both = full.join(long(again, "replayed"), ["cutoff", "symbol", "close_time", "feature"])
    a, b = F.col("full"), F.col("replayed")
    return both.where((a.isNull() != b.isNull()) | (F.abs(a - b) > atol + rtol * F.abs(a)))


def replay_audit(bars: DataFrame, cfg: Config, n_cutoffs: int = 6, rtol: float = 1e-8, atol: float = 1e-8, raise_on_failure: bool = True) -> DataFrame:
    """replay_differences of the matrix. Columns that look at the whole series by definition of the configured semantics are
    left out: LOOKS_AHEAD."""
    known = LOOKS_AHEAD if cfg.features.semantics == "reference" else ()

    def make(d: DataFrame) -> DataFrame:
        out = transform(d, cfg, drop_warmup=False)[0].drop(*known)
        return cut(out, out.columns)

    out = replay_differences(bars, make, cutoffs_of(bars, n_cutoffs), rtol, atol)
    out = cut(out, out.columns)
    if raise_on_failure and (bad := out.select("feature").distinct().limit(10).collect()):
        raise LeakageError(", ".join(r.feature for r in bad))
    return out

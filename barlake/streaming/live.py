"""Streams: ticks to closed bars under a watermark, and features of each new bar by replay over a trailing buffer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from barlake.bars import PRICES
from barlake.config import Config
from barlake.operators.zones import COLUMNS, Tracker
from barlake.plans.engine import transform
from barlake.plans.manifest import build
from barlake.streaming.features import prime


def stream_bars(ticks: DataFrame, minutes: int, delay: str = "10 minutes", ts: str = "ts", price: Column | str = "value", tick_id: str = "event_id", symbol: Column | None = None) -> DataFrame:
    """Bars of a stream of ticks, each told once the watermark has passed its close; later ticks are dropped."""
    price = F.col(price) if isinstance(price, str) else price
    rows = ticks.select((symbol if symbol is not None else F.lit("ALL")).alias("symbol"), F.col(ts).cast("timestamp").alias("t"), F.col(tick_id).alias("i"), price.alias("p")).withWatermark("t", delay)
    at = F.struct("t", "i")
    out = rows.groupBy("symbol", F.window("t", f"{minutes} minutes").alias("w")).agg(F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count("p").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), *PRICES, "volume")


TAKEN, TOLD = "ticks_taken", "ticks_told"


def observed_bars(ticks: DataFrame, minutes: int, *args, **options) -> DataFrame:
    """stream_bars() with two counts in the progress of the query: of the ticks that came, and of those in the bars told."""
    out = stream_bars(ticks.observe(TAKEN, F.count("*").alias("n")), minutes, *args, **options)
    return out.observe(TOLD, F.sum("volume").cast("long").alias("n"))


class TickCounts(StreamingQueryListener):
    """Adds up the counts of observed_bars() for each query, by its id, which a restart keeps."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        mine = self.sums.setdefault(str(p.id), {TAKEN: 0, TOLD: 0})
        for name in mine:
            if name in p.observedMetrics:
                mine[name] += p.observedMetrics[name].n or 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass


def late_ticks(spark: SparkSession, checkpoint: str, sums: dict[str, int]) -> int:
    """How many ticks came after the watermark had passed their bar: those taken that are in no bar told and wait in none.

    The waiting ones are read from the state that the query's checkpoint holds, between its runs. Ticks without a price
    are in no bar's volume, so a stream of them has to leave them out before.
    """
    state = spark.read.format("statestore").load(checkpoint)
    waiting = state.agg(F.sum("value.count").alias("n")).first().n or 0
    return sums[TAKEN] - sums[TOLD] - waiting


def buffer_rows(cfg: Config, spare: float = 1.25) -> int:
    """Bars that a replay keeps of each symbol: what the manifest's columns look back over, and some more."""
    return int(max(build(cfg).max_lookback, cfg.features.max_warmup_bars) * spare) + 10


def replay(cfg: Config, buffer: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], context: Callable[[], dict[str, DataFrame]] | None = None, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: recomputes the batch path over buffer() and the batch's bars and hands on the new rows.

    buffer() are the stored bars before the batch, of which the last keep of each symbol count, by default buffer_rows();
    sink must overwrite by key, as a batch may come twice.
    """
    keep = keep or buffer_rows(cfg)

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        old = prime(buffer(), keep)
        fresh = batch.join(old.select("symbol", "close_time"), ["symbol", "close_time"], "left_anti")
        matrix, _ = transform(old.unionByName(fresh.select(*old.columns)), cfg, context() if context else None, drop_warmup=False)
        sink(matrix.join(fresh.select("symbol", "close_time"), ["symbol", "close_time"], "left_semi"), batch_id)

    return run


def stateful_zones(bars: DataFrame, **cfg) -> DataFrame:
    """Zone columns of a stream of bars with atr: the batch path's tracker, kept as state per symbol."""
    import pickle

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(**cfg)
        frame = pd.concat(list(frames)).sort_values("close_time")
        rows = [tracker.step(tuple(x), a) for *x, a in zip(*(frame[c] for c in ("open", "high", "low", "close", "atr")), strict=True)] if len(frame) else []
        state.update((pickle.dumps(tracker),))
        yield pd.concat([frame[["symbol", "close_time"]].reset_index(drop=True), pd.DataFrame(rows, columns=COLUMNS, dtype="float64")], axis=1)

    schema = "symbol string, close_time timestamp, " + ", ".join(f"{x} double" for x in COLUMNS)
    return bars.groupBy("symbol").applyInPandasWithState(step, schema, "tracker binary", "append", GroupStateTimeout.NoTimeout)

"""Features of each new bar from state: what recursions, swings, levels and zones need of the past, and no bars but a few.

The state of a symbol is primed with the last bars of a store, so a stream goes on where history ends. Its size is fixed:
recursions and last events are numbers, windows keep as many bars as they look back over.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlake.calendars import Calendar
from barlake.functions.rolling import EPS
from barlake.operators.iir import ema, memory
from barlake.operators.zones import COLUMNS as ZONES
from barlake.operators.zones import Tracker

EMAS, MEMORY, SPAN, SWING = (20, 50, 100, 200), 6, 50, 2
LEVELS = ("prev_day", "prev_week")
TREND = (*(f"{x}_{n}{y}" for n in EMAS for x, y in (("dist_ema", "_atr"), ("ema_slope", ""))), "ema_stack_score", "rsi_14", "rsi_slope_5", "macd_hist_atr", "di_plus_14", "di_minus_14", "adx_14", "adx_slope_5")
SWINGS = (
    "swing_high_flag", "swing_low_flag", "last_swing_high_dist_atr", "last_swing_low_dist_atr", "last_swing_high_age", "last_swing_low_age", "hh", "hl", "lh", "ll", "structure_direction", "structure_strength",
    *(f"{x}_{n}" for x in ("bos", "mss") for n in ("bull", "bear", "strength", "age")), "range_high_dist_atr", "range_low_dist_atr", "range_position",
)
FEATURES = ("atr", *TREND, *SWINGS, *(f"dist_{x}_{s}_atr" for x in LEVELS for s in ("high", "low")))
#: Bars after which no recursion shows what came before.
PRIME = memory(*(ema("", "", n) for n in EMAS)) + SPAN


class Recursion:
    """y = (1 - alpha) y + alpha x from the first value on, told once least values are there."""

    def __init__(self, alpha: float, least: int, y: float | None = None, seen: int = 0):
        self.alpha, self.least, self.y, self.seen = alpha, least, y, seen

    @classmethod
    def ema(cls, n: int) -> Recursion:
        return cls(2 / (n + 1), n)

    @classmethod
    def wilder(cls, n: int) -> Recursion:
        return cls(1 / n, n)

    def step(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.y = x if self.seen == 0 else (1 - self.alpha) * self.y + self.alpha * x
        self.seen += 1
        return self.y if self.seen >= self.least else None


def over(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a / (b + EPS)


def less(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a - b


class Series:
    """What the features of one symbol's next bar need of all bars before it."""

    def __init__(self):
        named = {f"ema_{n}": Recursion.ema(n) for n in EMAS} | {"fast": Recursion.ema(12), "slow": Recursion.ema(26), "signal": Recursion.ema(9)}
        self.smooth = named | {n: Recursion.wilder(14) for n in ("atr", "gain", "loss", "plus", "minus", "range", "adx")}
        self.rn, self.last = 0, None
        self.bars: deque = deque(maxlen=SPAN)
        self.told: deque = deque(maxlen=5)
        self.swing = {"high": [None, None], "low": [None, None]}  # price and bar of the last one
        self.kind = {"hh": 0.0, "hl": 0.0, "lh": 0.0, "ll": 0.0}
        self.events: deque = deque(maxlen=MEMORY)
        self.broke, self.breach, self.shift = 0, [None, None], [None, None]  # side of the last break; size and bar

    def state(self) -> str:
        return json.dumps([{n: [r.y, r.seen] for n, r in self.smooth.items()}, self.rn, self.last, list(self.bars), list(self.told), self.swing, self.kind, list(self.events), self.broke, self.breach, self.shift])

    @classmethod
    def resume(cls, state: str) -> Series:
        s = cls()
        smooth, s.rn, s.last, bars, told, s.swing, s.kind, events, s.broke, s.breach, s.shift = json.loads(state)
        for n, (y, seen) in smooth.items():
            s.smooth[n].y, s.smooth[n].seen = y, seen
        for mine, kept in ((s.bars, bars), (s.told, told), (s.events, events)):
            mine.extend(kept)
        return s

    def step(self, o: float, h: float, lo: float, c: float) -> dict[str, float | None]:
        before = self.bars[-1] if self.bars else None
        tr = h - lo if before is None else max(h - lo, abs(h - before[3]), abs(lo - before[3]))
        a = self.smooth["atr"].step(tr)
        out: dict[str, float | None] = {"atr": a} | self.trend(h, lo, c, tr, a, before)
        self.bars.append([o, h, lo, c])
        out |= self.structure(h, lo, c, a)
        self.rn += 1
        return out

    def trend(self, h: float, lo: float, c: float, tr: float, a: float | None, before: list | None) -> dict[str, float | None]:
        s, out = self.smooth, {}
        e = {n: s[f"ema_{n}"].step(c) for n in EMAS}
        old = self.told[0] if len(self.told) == 5 else {}
        for n in EMAS:
            out[f"dist_ema_{n}_atr"] = over(less(c, e[n]), a)
            out[f"ema_slope_{n}"] = over(less(e[n], old.get(f"e{n}")), None if a is None else 5 * a)
        pairs = list(combinations(EMAS, 2))
        out["ema_stack_score"] = None if None in e.values() else sum(1.0 if e[i] > e[j] else -1.0 for i, j in pairs) / len(pairs)
        d = None if before is None else c - before[3]
        gain, loss = s["gain"].step(None if d is None else max(d, 0.0)), s["loss"].step(None if d is None else max(-d, 0.0))
        out["rsi_14"] = None if gain is None else 100 - 100 / (1 + gain / (loss + EPS))
        macd = less(s["fast"].step(c), s["slow"].step(c))
        out["macd_hist_atr"] = over(less(macd, s["signal"].step(macd)), a)
        up, down = (0.0, 0.0) if before is None else (h - before[1], before[2] - lo)
        plus, minus, spread = s["plus"].step(up if up > down and up > 0 else 0.0), s["minus"].step(down if down > up and down > 0 else 0.0), s["range"].step(tr)
        p, m = (None, None) if spread is None else (100 * plus / (spread + EPS), 100 * minus / (spread + EPS))
        adx = s["adx"].step(None if p is None else 100 * abs(p - m) / (p + m + EPS))
        out |= {"di_plus_14": p, "di_minus_14": m, "adx_14": adx, "adx_slope_5": less(adx, old.get("adx")), "rsi_slope_5": less(out["rsi_14"], old.get("rsi"))}
        self.told.append({f"e{n}": e[n] for n in EMAS} | {"adx": adx, "rsi": out["rsi_14"]})
        return out

    def structure(self, h: float, lo: float, c: float, a: float | None) -> dict[str, float | None]:
        out: dict[str, float | None] = {}
        recent = list(self.bars)[-(2 * SWING + 1) :]
        for side, column, better, kinds in (("high", 1, max, ("hh", "lh")), ("low", 2, min, ("hl", "ll"))):
            price = None
            if len(recent) == 2 * SWING + 1:
                middle = recent[SWING][column]
                price = middle if middle == better(b[column] for b in recent) else None
            out[f"swing_{side}_flag"] = float(price is not None)
            if price is not None:
                last = self.swing[side][0]
                if last is not None:
                    rising = price > last
                    self.kind[kinds[0]], self.kind[kinds[1]] = float(rising), float(not rising)
                    self.events.append(1 if rising else -1)
                self.swing[side] = [price, self.rn - SWING]
            price, bar = self.swing[side]
            out |= {f"last_swing_{side}_dist_atr": over(less(c, price), a), f"last_swing_{side}_age": None if bar is None else float(self.rn - bar)}
        k, total = self.kind, sum(self.events)
        out |= k
        out["structure_strength"] = abs(total) / len(self.events) if self.events else None
        trend = 0.0 if len(self.events) < 2 or not total else math.copysign(1.0, total)
        out["structure_direction"] = 1.0 if k["hh"] == 1 and k["hl"] == 1 else -1.0 if k["lh"] == 1 and k["ll"] == 1 else trend
        top, bottom = self.swing["high"][0], self.swing["low"][0]
        up, down = top is not None and c > top, bottom is not None and c < bottom
        now = 1 if up else -1 if down else 0
        turned = {"bull": now == 1 and self.broke <= 0, "bear": now == -1 and self.broke >= 0}
        if now:
            self.breach, self.broke = [c - top if up else bottom - c, self.rn], now
        if any(turned.values()):
            self.shift = list(self.breach)
        out |= {"bos_bull": float(up), "bos_bear": float(down), "mss_bull": float(turned["bull"]), "mss_bear": float(turned["bear"])}
        for name, (size, bar) in (("bos", self.breach), ("mss", self.shift)):
            out |= {f"{name}_strength": math.tanh(max(over(size, a) or 0.0, 0.0) / (1 + EPS)), f"{name}_age": None if bar is None else float(self.rn - bar)}
        full = len(self.bars) == SPAN
        high, low = (max(b[1] for b in self.bars), min(b[2] for b in self.bars)) if full else (None, None)
        return out | {"range_high_dist_atr": over(less(high, c), a), "range_low_dist_atr": over(less(c, low), a), "range_position": over(less(c, low), less(high, low))}


class LiveFeatures(StatefulProcessor):
    """State by symbol: a value for its recursions and swings, one for its zones, a map of levels by kind. A symbol that is
    silent for ttl milliseconds is forgotten, if ttl is given."""

    def __init__(self, ttl: int | None = None, **zones):
        self.ttl, self.zones = ttl, zones

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "state string", self.ttl)
        self.tracker = handle.getValueState("zones", "state string", self.ttl)
        self.levels = handle.getMapState("levels", "kind string", "id string, high double, low double, before_high double, before_low double", self.ttl)

    def level(self, kind: str, group: str, h: float, lo: float) -> tuple[float | None, float | None]:
        """High and low of the group before this bar's."""
        now = self.held.get(kind)
        if now is None:
            now = (group, h, lo, None, None)
        elif now[0] != group:
            now = (group, h, lo, now[1], now[2])
        else:
            now = (group, max(now[1], h), min(now[2], lo), now[3], now[4])
        self.held[kind] = now
        return now[3], now[4]

    def run(self, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """Features of the bars after the last one seen; earlier and repeated ones are left out."""
        series = Series.resume(self.series.get()[0]) if self.series.exists() else Series()
        tracker = Tracker(**self.zones)
        if self.tracker.exists():
            tracker.resume(self.tracker.get()[0])
        self.held = {k[0]: tuple(None if x is None or x != x else x for x in v) for k, v in self.levels.iterator()} if self.levels.exists() else {}
        frame = pd.concat(list(frames)).sort_values("close_time")
        out = []
        for s, t, micros, day, week, *bar in zip(*(frame[c] for c in ("symbol", "close_time", "micros", "day", "week", "open", "high", "low", "close")), strict=True):
            if series.last is not None and micros <= series.last:
                continue
            series.last = int(micros)
            row = series.step(*bar)
            for kind, group in zip(LEVELS, (day, week), strict=True):
                for side, price in zip(("high", "low"), self.level(kind, group, bar[1], bar[2]), strict=True):
                    row[f"dist_{kind}_{side}_atr"] = over(less(bar[3], price), row["atr"])
            out.append([s, t, *(row[n] for n in FEATURES), *tracker.step(tuple(bar), row["atr"])])
        self.series.update((series.state(),))
        self.tracker.update((tracker.state(),))
        for kind, v in self.held.items():
            self.levels.updateValue((kind,), v)
        return pd.DataFrame(out, columns=["symbol", "close_time", *FEATURES, *ZONES]).astype(dict.fromkeys([*FEATURES, *ZONES], "float64"))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.run(iter([initialState]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.run(rows)

    def close(self) -> None:
        pass


def columns(bars: DataFrame, calendar: Calendar) -> DataFrame:
    day = calendar.trading_day(F.col("close_time"))
    text = lambda d: d.cast("string")
    return bars.select("symbol", "close_time", F.unix_micros("close_time").alias("micros"), text(day).alias("day"), text(F.date_trunc("week", day).cast("date")).alias("week"), "open", "high", "low", "close")


def prime(bars: DataFrame, rows: int = PRIME) -> DataFrame:
    """The last bars of each symbol: as many as state can show."""
    newest = W.partitionBy("symbol").orderBy(F.desc("close_time"))
    return bars.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")


def live_features(bars: DataFrame, history: DataFrame | None = None, calendar: Calendar = Calendar(), ttl: int | None = None, **zones) -> DataFrame:
    """The features of a stream of closed bars. history are stored bars from before it; of each symbol the last PRIME start
    its state, on the first run of a query. Bars of a symbol count in the order of their close times, from its last one on.

    Needs RocksDB as the session's provider of state stores: see STATE_STORE. With ttl a query looks at the clock even when
    no bars come, so that a trigger of availableNow does not end.
    """
    from barlake.operators.zones import features

    schema = "symbol string, close_time timestamp, " + ", ".join(f"{x} double" for x in (*FEATURES, *ZONES))
    first = columns(prime(history), calendar).groupBy("symbol") if history is not None else None
    out = columns(bars, calendar).groupBy("symbol").transformWithStateInPandas(LiveFeatures(ttl, **zones), schema, "Append", "ProcessingTime" if ttl else "None", first)
    return features(out, zones.get("gap_age", 288), zones.get("block_age", 288)).drop(*ZONES)


#: Session settings that state with values, maps and time to live needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

"""Price-gap and order-block zones: the two path-dependent states, one kernel for batch and stream.

Short sides are long sides of mirrored prices, so each kind of zone has one rule. A long series is worked on in chunks at
once: each starts from the state that the bars before it lead to from nothing, and those whose guess was not what the chunk
before them ended with are done again from that, until none is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.rolling import EPS, clip, squash
from barlake.operators import scan
from barlake.sources.scratch import Steps

# The features of each kind of zone.
GAP = ("exists", "size", "dist", "age", "fill", "count")
BLOCK = ("exists", "dist", "size", "age", "displacement", "mitigated", "mitigation")
COLUMNS = [f"_fvg_{s}_{f}" for s in ("bull", "bear") for f in GAP] + [f"_ob_{s}_{f}" for s in ("bull", "bear") for f in BLOCK] + ["_ob_confluence"]


@dataclass
class Side:
    """Zones of one side. A zone is [bottom, top, bar it was born, deepest price since, displacement, with a gap]."""

    sign: float
    gaps: list = field(default_factory=list)
    blocks: list = field(default_factory=list)

    def bar(self, i: int, past: list[tuple], bar: tuple, atr: float, cfg: dict) -> dict[str, float]:
        o, h, lo, c = self.view(bar)
        out = dict.fromkeys([f"gap_{f}" for f in GAP] + [f"block_{f}" for f in BLOCK] + ["had_gap"], 0.0)
        gap = False
        if len(past) >= 2:
            two, one = self.view(past[-2]), self.view(past[-1])
            gap = lo > two[1]
            if gap and lo - two[1] >= cfg["min_gap"] * atr:
                self.gaps.append([two[1], lo, i, lo])
            move = (c - one[3]) / atr
            if move >= cfg["displacement"]:
                source = next((x for x in (one, two) if x[3] < x[0]), None)
                if source:
                    self.blocks.append([source[2], source[1], i, float("inf"), move, gap])
        self.gaps = self.alive(self.gaps, i, lo, c, cfg["gap_age"], cfg["gaps"])
        self.blocks = self.alive(self.blocks, i, lo, c, cfg["block_age"], cfg["blocks"])
        out["gap_count"] = float(len(self.gaps))
        if self.gaps:
            bottom, top, born, deep = self.gaps[0]
            out |= {"gap_exists": 1.0, "gap_size": (top - bottom) / atr, "gap_dist": (c - top) / atr, "gap_age": float(i - born), "gap_fill": self.share(bottom, top, deep)}
        if self.blocks:
            bottom, top, born, deep, move, with_gap = self.blocks[0]
            used = self.share(bottom, top, deep)
            out |= {"block_exists": 1.0, "block_size": (top - bottom) / atr, "block_dist": (c - top) / atr, "block_age": float(i - born), "block_displacement": move}
            out |= {"block_mitigation": used, "block_mitigated": float(used > 0), "had_gap": float(with_gap)}
        return out

    def view(self, bar: tuple) -> tuple:
        o, h, lo, c = bar
        return bar if self.sign > 0 else (-o, -lo, -h, -c)

    @staticmethod
    def share(bottom: float, top: float, deep: float) -> float:
        return min(1.0, max(0.0, (top - deep) / (top - bottom + EPS)))

    @staticmethod
    def alive(zones: list, i: int, lo: float, c: float, age: int, keep: int) -> list:
        """Zones neither too old nor traded through, the nearest few."""
        left = []
        for z in zones:
            if i - z[2] <= age:
                z[3] = min(z[3], lo)
                if z[3] > z[0]:
                    left.append(z)
        return sorted(left, key=lambda z: abs(c - z[1]))[:keep]


class Tracker:
    """State of one series; step takes a bar and its ATR and returns the zone columns."""

    def __init__(self, min_gap=0.15, gap_age=288, gaps=3, displacement=1.0, block_age=288, blocks=2):
        self.cfg = {"min_gap": min_gap, "gap_age": gap_age, "gaps": gaps, "displacement": displacement, "block_age": block_age, "blocks": blocks}
        self.sides, self.past, self.i = {"bull": Side(1.0), "bear": Side(-1.0)}, [], 0

    def step(self, bar: tuple, atr: float | None) -> list[float]:
        row = dict.fromkeys(COLUMNS, 0.0)
        if atr is not None and atr == atr and 0 < atr < float("inf"):
            for name, side in self.sides.items():
                got = side.bar(self.i, self.past, bar, atr, self.cfg)
                row |= {f"_fvg_{name}_{f}": got[f"gap_{f}"] for f in GAP} | {f"_ob_{name}_{f}": got[f"block_{f}"] for f in BLOCK}
                row["_ob_confluence"] = max(row["_ob_confluence"], got["had_gap"])
        self.past = [*self.past[-1:], bar]
        self.i += 1
        return list(row.values())

    def state(self) -> str:
        """All that later bars depend on, as text; equal states are equal texts."""
        return json.dumps([self.i, self.past, {n: asdict(s) for n, s in self.sides.items()}])

    def resume(self, state: str) -> None:
        self.i, past, sides = json.loads(state)
        self.past, self.sides = [tuple(x) for x in past], {n: Side(**s) for n, s in sides.items()}


def kernel(frames: Iterator[pd.DataFrame], **cfg) -> Iterator[pd.DataFrame]:
    """Bars sorted by symbol and time; the state of one series at a time, whatever its length."""
    symbol, tracker = object(), None
    for frame in frames:
        out = []
        for s, o, h, lo, c, a in zip(*(frame[x] for x in ("symbol", "open", "high", "low", "close", "atr")), strict=True):
            if s != symbol:
                symbol, tracker = s, Tracker(**cfg)
            out.append(tracker.step((o, h, lo, c), a))
        yield pd.concat([frame[["symbol", "close_time"]].reset_index(drop=True), pd.DataFrame(out, columns=COLUMNS, dtype="float64")], axis=1)


BARS = ("open", "high", "low", "close", "atr")


def chunk_kernel(rows: pd.DataFrame, start: str | None, **cfg) -> pd.DataFrame:
    """Zone columns of a chunk's own bars, and on the last of them the states with which the chunk started and ended.

    rows have rn and own; without a start the bars before the first own one lead to it from nothing.
    """
    rows = rows.sort_values("rn")
    tracker, out, own = Tracker(**cfg), [], rows["own"].to_numpy()
    tracker.i = int(rows["rn"].iloc[0])
    bars = list(zip(*(rows[x] for x in BARS), strict=True))
    if start is not None:
        tracker.resume(start)
        bars, rows, own = [b for b, x in zip(bars, own, strict=True) if x], rows[own], own[own]
    for (*bar, atr), mine in zip(bars, own, strict=True):
        if mine and not out:
            start = tracker.state()
        row = tracker.step(tuple(bar), atr)
        if mine:
            out.append(row)
    done = pd.concat([rows.loc[own, ["symbol", "chunk", "close_time"]].reset_index(drop=True), pd.DataFrame(out, columns=COLUMNS, dtype="float64")], axis=1)
    done["started"], done["ended"] = None, None
    if out:
        done.loc[len(done) - 1, ["started", "ended"]] = start, tracker.state()
    return done


def states_in_chunks(df: DataFrame, chunk_rows: int, lead: int, steps: Steps, **cfg) -> DataFrame:
    """The zone columns of df, which has rn, by chunks of so many rows; the first states come from lead rows before each.

    A round does again only the chunks whose start was not the end of the one before them. The first wrong chunk of a
    series is right after it, so rounds end; a state forgets zones by their age, so one or two are the rule.
    """
    schema = "symbol string, chunk long, close_time timestamp, " + ", ".join(f"{x} double" for x in COLUMNS) + ", started string, ended string"
    own = F.floor(F.col("rn") / chunk_rows)
    spread = df.select("symbol", "close_time", "rn", *BARS, F.explode(F.sequence(own, F.floor((F.col("rn") + lead) / chunk_rows))).alias("chunk"))
    spread = spread.withColumn("own", F.col("chunk") == F.floor(F.col("rn") / chunk_rows))
    mine = lambda rows: rows if rows["own"].any() else rows.iloc[:0]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return chunk_kernel(rows, None, **cfg) if len(mine(rows)) else pd.DataFrame(columns=["symbol", "chunk", "close_time", *COLUMNS, "started", "ended"])

    def again(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return chunk_kernel(rows, starts["start"].iloc[0], **cfg)

    done = steps.cut(spread.groupBy("symbol", "chunk").applyInPandas(first, schema))
    while True:
        ends = done.where("ended IS NOT NULL").select("symbol", "chunk", "started", "ended")
        before = F.lag("ended").over(scan.W.partitionBy("symbol").orderBy("chunk"))
        wrong = steps.cut(ends.withColumn("start", before).where("start <> started").select("symbol", "chunk", "start"))
        if wrong.isEmpty():
            return done.drop("started", "ended", "chunk")
        rows = spread.where("own").join(wrong.select("symbol", "chunk"), ["symbol", "chunk"], "left_semi")
        redone = rows.groupBy("symbol", "chunk").cogroup(wrong.groupBy("symbol", "chunk")).applyInPandas(again, schema)
        done = steps.cut(done.join(wrong.select("symbol", "chunk"), ["symbol", "chunk"], "left_anti").unionByName(redone))


def zones(df: DataFrame, chunk_rows: int | None = None, **cfg) -> DataFrame:
    """df (with atr) with the price-gap and order-block features. A series is one task's, or with chunk_rows that of many;
    df then has rn, and is read more than once."""
    if chunk_rows:
        ages = cfg.get("gap_age", 288), cfg.get("block_age", 288)
        steps = Steps(df.sparkSession)
        state = states_in_chunks(df, chunk_rows, min(chunk_rows, 2 * max(ages)), steps, **cfg)
    else:
        rows = df.select("symbol", "close_time", *BARS).repartition("symbol").sortWithinPartitions("symbol", "close_time")
        state = rows.mapInPandas(lambda it: kernel(it, **cfg), "symbol string, close_time timestamp, " + ", ".join(f"{x} double" for x in COLUMNS))
    return features(df.join(state, ["symbol", "close_time"]), cfg.get("gap_age", 288), cfg.get("block_age", 288))


def features(df: DataFrame, gap_age: int = 288, block_age: int = 288) -> DataFrame:
    out = {}
    for s in ("bull", "bear"):
        g, b = (lambda f, s=s: F.col(f"_fvg_{s}_{f}")), (lambda f, s=s: F.col(f"_ob_{s}_{f}"))
        out |= {f"fvg_{s}_exists": g("exists"), f"fvg_{s}_size_atr": g("size"), f"fvg_{s}_dist_atr": g("dist"), f"fvg_{s}_age": g("age"), f"fvg_{s}_fill_pct": g("fill")}
        out[f"fvg_{s}_strength"] = squash(g("size")) * (1 - clip(g("age") / gap_age, 0, 1)) * (1 - g("fill"))
        out |= {f"ob_{s}_exists": b("exists"), f"ob_{s}_dist_atr": b("dist"), f"ob_{s}_size_atr": b("size"), f"ob_{s}_age": b("age")}
        out[f"ob_{s}_strength"] = squash(b("displacement"), 2.0) * (1 - clip(b("age") / block_age, 0, 1)) * (1 - b("mitigation")) * b("exists")
        out |= {f"ob_{s}_mitigated": b("mitigated"), f"ob_{s}_mitigation_pct": b("mitigation")}
    n, m = F.col("_fvg_bull_count"), F.col("_fvg_bear_count")
    out |= {"fvg_count_bull": n, "fvg_count_bear": m, "fvg_imbalance": (n - m) / (n + m + EPS), "ob_confluence_fvg": F.col("_ob_confluence")}
    return df.withColumns(out)

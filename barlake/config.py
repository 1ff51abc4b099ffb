"""Configuration: strict nested dataclasses, layered sources, and a hash that names a feature set."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

from barlake.calendars import SESSIONS, Calendar, Session
from barlake.operators.quality import Cleaning
from barlake.sources.csv_bars import CsvSource
from barlake.timeframes import Timeframe


class ConfigError(ValueError):
    pass


# The names and defaults of all options below.


@dataclass(frozen=True)
class Validation:
    min_completeness: float = 0.9
    max_null_fraction: float = 0.01
    extreme_return_sigma: float = 12.0
    max_gap_bars_reported: int = 20
    flag_zero_volume: bool = True
    fail_on_error: bool = True


@dataclass(frozen=True)
class Resampling:
    daily_anchor_tz: str = "America/New_York"
    daily_anchor_time: str = "17:00"
    h4_anchor_offset_minutes: int = 0
    min_bars_for_complete: float = 0.5
    drop_incomplete_last_bar: bool = True


@dataclass(frozen=True)
class Data:
    source: CsvSource = field(default_factory=CsvSource)
    context_timeframes: tuple[str, ...] = ("15m", "1h", "4h", "1d")
    validation: Validation = field(default_factory=Validation)
    cleaning: Cleaning = field(default_factory=Cleaning)
    resample: Resampling = field(default_factory=Resampling)


@dataclass(frozen=True)
class Sessions:
    windows: tuple[Session, ...] = SESSIONS
    tradable: tuple[str, ...] = ("LONDON", "NY", "LONDON_NY_OVERLAP")


@dataclass(frozen=True)
class Price:
    enabled: bool = True
    return_periods: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)
    zscore_periods: tuple[int, ...] = (20, 50, 100)


@dataclass(frozen=True)
class Volatility:
    enabled: bool = True
    atr_periods: tuple[int, ...] = (14, 50)
    percentile_windows: tuple[int, ...] = (252, 1000)
    bb_percentile_window: int = 252


@dataclass(frozen=True)
class Volume:
    enabled: bool = True
    time_of_day_days: int = 20


@dataclass(frozen=True)
class Trend:
    enabled: bool = True
    ema_periods: tuple[int, ...] = (20, 50, 100, 200)
    linreg_periods: tuple[int, ...] = (20, 50)
    hurst_period: int = 100


@dataclass(frozen=True)
class Structure:
    enabled: bool = True
    swing_k: int = 2
    structure_memory: int = 6
    range_period: int = 50


@dataclass(frozen=True)
class Liquidity:
    enabled: bool = True
    sweep_lookback: int = 12
    sweep_tolerance_atr: float = 0.1
    level_cluster_atr: float = 0.5


@dataclass(frozen=True)
class Zones:
    enabled: bool = True
    max_tracked: int = 3
    min_size_atr: float = 0.15
    max_age_bars: int = 288


@dataclass(frozen=True)
class OrderBlocks:
    enabled: bool = True
    max_tracked: int = 2
    displacement_atr: float = 1.0
    max_age_bars: int = 288


@dataclass(frozen=True)
class Patterns:
    enabled: bool = True


@dataclass(frozen=True)
class Clock:
    enabled: bool = True
    session_vol_days: int = 20


@dataclass(frozen=True)
class Frames:
    enabled: bool = True
    timeframes: tuple[str, ...] = ("15m", "1h", "4h", "1d")
    groups: tuple[str, ...] = ("price", "volatility", "trend", "structure")
    include_running_position: bool = True
    ema_periods: tuple[int, ...] = (20, 50)
    percentile_windows: tuple[int, ...] = (100,)


@dataclass(frozen=True)
class Features:
    max_warmup_bars: int = 1200
    gap_flag_bars: int = 12
    semantics: str = "reference"
    price: Price = field(default_factory=Price)
    volatility: Volatility = field(default_factory=Volatility)
    volume: Volume = field(default_factory=Volume)
    trend: Trend = field(default_factory=Trend)
    structure: Structure = field(default_factory=Structure)
    liquidity: Liquidity = field(default_factory=Liquidity)
    fvg: Zones = field(default_factory=Zones)
    order_blocks: OrderBlocks = field(default_factory=OrderBlocks)
    patterns: Patterns = field(default_factory=Patterns)
    time: Clock = field(default_factory=Clock)
    mtf: Frames = field(default_factory=Frames)


@dataclass(frozen=True)
class Config:
    symbol: str = "ALL"
    base_timeframe: str = "5m"
    seed: int = 42
    log_level: str = "INFO"
    data_root: str = "data"
    artifact_root: str = "artifacts"
    data: Data = field(default_factory=Data)
    calendar: Calendar = field(default_factory=Calendar)
    sessions: Sessions = field(default_factory=Sessions)
    features: Features = field(default_factory=Features)

    def __post_init__(self):
        base = Timeframe(self.base_timeframe).minutes
        for tf in {*self.features.mtf.timeframes, *(self.data.context_timeframes if self.data.source.path else ())}:
            if Timeframe(tf).minutes <= base or Timeframe(tf).minutes % base:
                raise ConfigError(f"{tf} is no coarser multiple of {self.base_timeframe}")
        if self.data.source.path and self.data.source.minutes != base:
            raise ConfigError(f"the source has bars of {self.data.source.minutes} minutes, the base is {self.base_timeframe}")
        if self.features.semantics not in ("reference", "causal"):
            raise ConfigError("features.semantics is reference or causal")

    def store(self, name: str) -> str:
        """Folder of the stored bars, resampled bars, reports or features."""
        return f"{self.artifact_root if name == 'features' else self.data_root}/{name}"


def build(kind: Any, values: Any) -> Any:
    """A value of a declared type from plain ones: dataclasses from dicts, tuples and sets from lists. Unknown keys, and
    values of another type, are refused."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(values, dict):
            raise ConfigError(f"{kind.__name__} takes named values")
        types = get_type_hints(kind)
        if extra := set(values) - {f.name for f in fields(kind)}:
            raise ConfigError(f"unknown keys for {kind.__name__}: {sorted(extra)}")
        return kind(**{k: build(types[k], v) for k, v in values.items()})
    many, inner = get_origin(kind), get_args(kind)
    if many in (tuple, frozenset) and isinstance(values, list | tuple):
        kinds = inner if many is tuple and inner[-1] is not ... else (inner[0],) * len(values)
        return many(build(k, v) for k, v in zip(kinds, values, strict=True))
    if many is dict and isinstance(values, dict):
        return {build(inner[0], k): build(inner[1], v) for k, v in values.items()}
    if many in (Union, UnionType):
        return None if values is None else build(next(x for x in inner if x is not type(None)), values)
    if kind is float and isinstance(values, int) and not isinstance(values, bool):
        return float(values)
    if not isinstance(kind, type) or not isinstance(values, kind) or (kind is int and isinstance(values, bool)):
        raise ConfigError(f"{values!r} is no {getattr(kind, '__name__', kind)}")
    return values


def merge(a: dict, b: dict) -> dict:
    return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def load(paths: list[str | Path] = (), overrides: list[str] = (), env: dict[str, str] | None = None) -> Config:
    """YAML files in order, then BARLAKE_* variables, then a.b=value overrides."""
    import yaml

    values: dict[str, Any] = {}
    for p in paths:
        values = merge(values, yaml.safe_load(Path(p).read_text()) or {})
    env = os.environ if env is None else env
    for name in ("data_root", "artifact_root", "log_level", "seed"):
        if (v := env.get(f"BARLAKE_{name.upper()}")) is not None:
            values[name] = yaml.safe_load(v)
    for item in overrides:
        key, _, v = item.partition("=")
        node: dict[str, Any] = {}
        leaf = node
        *path, last = key.split(".")
        for part in path:
            leaf = leaf.setdefault(part, {})
        leaf[last] = yaml.safe_load(v)
        values = merge(values, node)
    return build(Config, values)


def plain(x: Any) -> Any:
    """x in terms of JSON: dataclasses as objects, tuples as lists, sets as sorted lists."""
    if dataclasses.is_dataclass(x):
        return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, frozenset):
        return sorted(map(plain, x))
    return [plain(v) for v in x] if isinstance(x, tuple | list) else x


def fingerprint(x: Any, prefix: str = "", digits: int = 10) -> str:
    """A short name of a configuration: equal ones, whatever the order of their keys, have equal names."""
    return prefix + hashlib.sha256(json.dumps(plain(x), sort_keys=True).encode()).hexdigest()[:digits]

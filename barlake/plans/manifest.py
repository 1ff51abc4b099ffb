"""What a feature matrix declares: the ordered columns, where they come from, and how far back they look."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from barlake.config import Config, Features, fingerprint
from barlake.functions.groups import LEVELS
from barlake.timeframes import Timeframe


class FeatureError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    name: str
    group: str
    lookback: int


def price(returns, zscores, **_) -> list[tuple[str, int]]:
    out = [(f"{n}_ret", 2) for n in ("open", "high", "low", "close")] + [(n, 1) for n in ("body_ret", "range_ret", "upper_wick", "lower_wick", "body_to_range", "close_position")]
    out += [(n, 15) for n in ("high_low_range_atr", "open_close_range_atr", "gap_atr")]
    return out + [(f"ret_{k}_atr", k + 15) for k in returns] + [(f"zscore_close_{n}", n) for n in zscores] + [("dist_sma_20_atr", 35)]


def volatility(atrs, percentiles, bb_rank, **_) -> list[tuple[str, int]]:
    out = [(f"atr_{n}", n + 1) for n in atrs] + [("atr_pct", 15), ("atr_ratio_fast_slow", max(atrs) + 1)] + [(f"atr_percentile_{n}", n) for n in percentiles]
    out += [("realized_vol_20", 21), ("realized_vol_50", 51), ("parkinson_vol_20", 21), ("garman_klass_vol_20", 21), ("vol_of_vol_50", 71), ("range_expansion", 21), ("range_compression", 51)]
    out += [("nr7", 7), ("wr7", 7), ("bb_width_20", 20), (f"bb_width_percentile_{bb_rank}", bb_rank), ("squeeze_flag", 21)]
    return out + [(n, max(percentiles)) for n in ("vol_regime", *(f"vol_regime_is_{x}" for x in ("low", "normal", "high", "extreme")))]


def volume(per_day, **_) -> list[tuple[str, int]]:
    out = [("volume_ma_20", 20), ("volume_ma_50", 50), ("volume_ratio", 20), ("relative_volume_tod", 20 * per_day), ("volume_zscore_50", 50), ("volume_expansion", 50), ("volume_compression", 50)]
    return out + [("buy_pressure", 1), ("volume_weighted_buy_pressure", 20), ("cvd_proxy_20", 70), ("cvd_proxy_50", 100), ("obv_slope_20", 21), ("dist_vwap_atr", 1), ("volume_is_missing", 1)]


def trend(emas, regressions, hurst, **_) -> list[tuple[str, int]]:
    out = [x for n in emas for x in ((f"dist_ema_{n}_atr", n + 15), (f"ema_slope_{n}", n + 20))]
    out += [("ema_stack_score", max(emas)), ("ema_20_50_spread_atr", sorted(emas)[1] + 15), ("ema_50_200_spread_atr", max(emas) + 15)]
    out += [("adx_14", 42), ("di_plus_14", 28), ("di_minus_14", 28), ("di_diff", 28), ("adx_slope_5", 47), ("macd_hist_atr", 41), ("rsi_14", 28), ("rsi_slope_5", 33), ("rsi_divergence_20", 48)]
    out += [("stoch_k_14", 15), ("stoch_d_3", 18), ("cci_20_norm", 21), ("williams_r_14", 15)]
    out += [x for n in regressions for x in ((f"linreg_slope_{n}_atr", n + 15), (f"linreg_r2_{n}", n))]
    return out + [("efficiency_ratio_20", 21), (f"hurst_vr_{hurst}", hurst + 10)]


def structure(k=2, memory=6, span=50, **_) -> list[tuple[str, int]]:
    w = 2 * k + 1
    out = [(n, w) for n in ("swing_high_flag", "swing_low_flag", "last_swing_high_dist_atr", "last_swing_low_dist_atr", "last_swing_high_age", "last_swing_low_age")]
    out += [(n, 2 * w) for n in ("hh", "hl", "lh", "ll", "structure_direction")] + [("structure_strength", 50)] + [(f"bos_{n}", w) for n in ("bull", "bear", "strength", "age")]
    out += [(f"mss_{n}", 2 * w) for n in ("bull", "bear", "strength", "age")]
    return out + [(n, span) for n in ("range_high_dist_atr", "range_low_dist_atr", "range_width_atr", "range_position", "consolidation_score")]


def liquidity(per_day, **_) -> list[tuple[str, int]]:
    names = [f"dist_{x}_atr" for x in LEVELS] + ["nearest_level_above_atr", "nearest_level_below_atr", "level_cluster_density", "sweep_high", "sweep_low", "sweep_strength", "sweep_age", "sweep_direction", "stop_hunt_score", "rejection_after_sweep"]
    return [(n, per_day) for n in names] + [("equal_highs_count_50", 50), ("equal_lows_count_50", 50)]


def fvg(**_) -> list[tuple[str, int]]:
    return [(f"fvg_{s}_{f}", 3) for s in ("bull", "bear") for f in ("exists", "size_atr", "dist_atr", "age", "fill_pct", "strength")] + [("fvg_count_bull", 3), ("fvg_count_bear", 3), ("fvg_imbalance", 3)]


def order_blocks(**_) -> list[tuple[str, int]]:
    return [(f"ob_{s}_{f}", 3) for s in ("bull", "bear") for f in ("exists", "dist_atr", "size_atr", "age", "strength", "mitigated", "mitigation_pct")] + [("ob_confluence_fvg", 3)]


def patterns(**_) -> list[tuple[str, int]]:
    reach = {"engulf": 17, "pinbar": 16, "rejection": 16, "breakout": 36, "momentum": 21, "double_retest": 36}
    return [(f"{n}_{s}_strength", k) for n, k in reach.items() for s in ("bull", "bear")] + [("compression_strength", 8)]


def time(per_day, **_) -> list[tuple[str, int]]:
    out = [f"{n}_{f}" for n in ("hour", "minute_of_day", "dow", "month") for f in ("sin", "cos")] + ["day_of_week", "is_month_end", "is_quarter_end"]
    out += [f"session_is_{n}" for n in ("asia", "london", "ny", "london_ny_overlap", "off")]
    out += ["session_progress", "bars_since_session_open", "is_session_first_hour", "is_session_last_hour", "session_range_atr", "session_atr_ratio", "session_trend", "bars_since_gap", "is_post_gap"]
    return [(n, 20 * per_day if n == "session_atr_ratio" else 1) for n in out]


BASE = {f.__name__: f for f in (price, volatility, volume, trend, structure, liquidity, fvg, order_blocks, patterns, time)}
RUNNING = ("progress", "range_atr", "position", "return_atr")
COARSE = ("price", "volatility", "trend", "structure")


def parameters(f: Features, coarse: bool, per_day: int) -> dict:
    c = f.mtf
    return {
        "returns": (1, 3, 5) if coarse else f.price.return_periods, "zscores": (20,) if coarse else f.price.zscore_periods, "atrs": f.volatility.atr_periods,
        "percentiles": c.percentile_windows if coarse else f.volatility.percentile_windows, "bb_rank": c.percentile_windows[0] if coarse else f.volatility.bb_percentile_window,
        "emas": c.ema_periods if coarse else f.trend.ema_periods, "regressions": (20,) if coarse else f.trend.linreg_periods, "hurst": 50 if coarse else f.trend.hurst_period,
        "k": f.structure.swing_k, "memory": f.structure.structure_memory, "span": f.structure.range_period, "per_day": per_day,
    }


def specs(cfg: Config, context: list[str] | None = None) -> list[Spec]:
    """Declared columns in order: base groups, each coarse frame's groups, running, cross."""
    f, base = cfg.features, Timeframe(cfg.base_timeframe)
    context = list(f.mtf.timeframes) if context is None else context
    own = parameters(f, False, base.bars_per_day)
    out = [Spec(n, g, k) for g, names in BASE.items() if getattr(f, g).enabled for n, k in names(**own)]
    if f.mtf.enabled and context:
        coarse = parameters(f, True, 1)
        for tf in context:
            ratio = Timeframe(tf).minutes // base.minutes
            out += [Spec(f"{n}_{tf}", g, k * ratio) for g in COARSE if g in f.mtf.groups for n, k in BASE[g](**coarse)]
        if f.mtf.include_running_position:
            out += [Spec(f"running_{n}_{tf}", "running", Timeframe(tf).minutes // base.minutes) for tf in context if tf != "1d" for n in RUNNING]
        out += [Spec(n, "cross", 1) for n in ("htf_trend_agreement", "htf_alignment_score", "htf_base_agreement", *(f"tf_vol_ratio_base_{tf}" for tf in context))]
    names = [s.name for s in out]
    if len(set(names)) < len(names):
        raise FeatureError("a feature name is declared twice")
    return out


@dataclass(frozen=True)
class Manifest:
    version: str
    symbol: str
    base_timeframe: str
    context: list[str]
    columns: list[dict]
    max_lookback: int
    warmup: int
    notes: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    def assert_compatible(self, names: list[str]) -> None:
        if names != self.names:
            raise FeatureError("columns differ from the manifest in name or order")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))


def build(cfg: Config, context: list[str] | None = None) -> Manifest:
    found = specs(cfg, context)
    reach = max((s.lookback for s in found), default=0)
    return Manifest(fingerprint(cfg.features, "fs_"), cfg.symbol, cfg.base_timeframe, list(cfg.features.mtf.timeframes) if context is None else context, [asdict(s) for s in found], reach, min(reach, cfg.features.max_warmup_bars))

"""Feature groups that windows express. Each takes bars with symbol, close_time, rn and the shared columns and adds its own.

Columns that begin with an underscore are steps on the way.
"""

from __future__ import annotations

import math
from collections.abc import Collection
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.functions.rolling import EPS, clip, flag, high, lag, linreg, low, mean, numbered, rank_pct, rolling, rows, series, squash, std, total, zscore
from barlake.operators import scan
from barlake.operators.chunks import in_chunks
from barlake.operators.iir import ema, memory, smooth, wilder
from barlake.sources.scratch import Steps

col = F.col


def shared(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """bars with rn, true range and the primary ATR: computed once, used by all groups. With chunk_rows no window is over a
    whole series: numbers come from a scan, the rest from chunks."""
    first = wilder("atr", "_tr", 14)

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("_c1", lag("close"))
        tr = F.greatest(col("high") - col("low"), F.abs(col("high") - col("_c1")), F.abs(col("low") - col("_c1")))
        return smooth(df.withColumns({"_tr": tr, "_range": col("high") - col("low"), "_body": col("close") - col("open"), "_d": col("close") - col("_c1")}), first)

    return in_chunks(scan.numbered(bars), step, memory(first) + 1, chunk_rows) if chunk_rows else step(numbered(bars))


def reach(group: str, **p) -> int | None:
    """Rows that the windows of a group look back over, one after another, with the parameters of a manifest; None where
    some look back over a whole session or series."""
    if group == "price":
        return max(*p["returns"], *p["zscores"], 20)
    if group == "volatility":
        smooths = [wilder("", "", n) for n in (*p["atrs"], 20)]
        return memory(*smooths) + 1 + max(*p["percentiles"], p["bb_rank"] + 20, 20 + 50)
    if group == "trend":
        # The index of direction is smoothed twice, and slopes look back from there.
        twice = 2 * memory(wilder("", "", 14)) + 6
        return max(memory(*(ema("", "", n) for n in p["emas"])) + 6, memory(ema("", "", 26)) + memory(ema("", "", 9)), twice + 20, max(p["regressions"]), p["hurst"] + 8, 40)
    return {"patterns": 2 * 21}.get(group)


def price(df: DataFrame, returns=(1, 2, 3, 5, 10, 20, 50), zscores=(20, 50, 100)) -> DataFrame:
    o, h, lo, cl, c1, a, r = (col(x) for x in ("open", "high", "low", "close", "_c1", "atr", "_range"))
    top, bottom = F.greatest(o, cl), F.least(o, cl)
    out = {f"{n}_ret": F.log(col(n) / c1) for n in ("open", "high", "low", "close")}
    out |= {"body_ret": (cl - o) / cl, "range_ret": r / cl, "upper_wick": (h - top) / (r + EPS), "lower_wick": (bottom - lo) / (r + EPS)}
    out |= {"body_to_range": F.abs(cl - o) / (r + EPS), "close_position": (cl - lo) / (r + EPS)}
    out |= {"high_low_range_atr": r / (a + EPS), "open_close_range_atr": F.abs(cl - o) / (a + EPS), "gap_atr": (o - c1) / (a + EPS)}
    out |= {f"ret_{k}_atr": (F.log(cl) - F.log(lag("close", k))) * cl / (a + EPS) / math.sqrt(k) for k in returns}
    out |= {f"zscore_close_{n}": zscore("close", n) for n in zscores}
    return df.withColumns(out | {"dist_sma_20_atr": (cl - mean("close", 20)) / (a + EPS)})


def volatility(df: DataFrame, atrs=(14, 50), percentiles=(252, 1000), realized=(20, 50), bb_rank: int = 252, bars_per_day: int = 288) -> DataFrame:
    df = smooth(df, *(wilder(f"atr_{n}", "_tr", n) for n in atrs), wilder("_atr20", "_tr", 20), ema("_ema20", "close", 20))
    hl = F.log(F.greatest(col("high") / (col("low") + EPS), F.lit(1e-9)))
    co = F.log(F.greatest(col("close") / (col("open") + EPS), F.lit(1e-9)))
    df = df.withColumns({"_lr": F.log(col("close")) - F.log("_c1"), "_hl2": hl * hl, "_gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co})
    df = df.withColumns({f"realized_vol_{n}": std("_lr", n) * math.sqrt(bars_per_day) for n in realized} | {"bb_width_20": 4 * std("close", 20) / (mean("close", 20) + EPS)})
    r = col("_range")
    out = {"atr_pct": col("atr") / (col("close") + EPS), "atr_ratio_fast_slow": col(f"atr_{min(atrs)}") / (col(f"atr_{max(atrs)}") + EPS)}
    out |= {f"atr_percentile_{n}": rank_pct("atr", n) for n in percentiles}
    out |= {"parkinson_vol_20": F.sqrt(mean("_hl2", 20) / (4 * math.log(2))), "garman_klass_vol_20": F.sqrt(F.greatest(mean("_gk", 20), F.lit(0.0)))}
    out |= {"vol_of_vol_50": std("realized_vol_20", 50), "range_expansion": r / (mean("_range", 20) + EPS), "range_compression": mean("_range", 5) / (mean("_range", 50) + EPS)}
    out |= {"nr7": flag(r <= low("_range", 7)), "wr7": flag(r >= high("_range", 7)), f"bb_width_percentile_{bb_rank}": rank_pct("bb_width_20", bb_rank)}
    df = df.withColumns(out | {"squeeze_flag": flag(col("bb_width_20") < 3 * col("_atr20") / (col("_ema20") + EPS))})
    p = col(f"atr_percentile_{max(percentiles)}")
    df = df.withColumn("vol_regime", F.when(p < 0.2, 0.0).when(p < 0.8, 1.0).when(p < 0.95, 2.0).when(p.isNotNull(), 3.0))
    return df.withColumns({f"vol_regime_is_{n}": flag(col("vol_regime") == k) for k, n in enumerate(("low", "normal", "high", "extreme"))})


def volume(df: DataFrame, means=(20, 50), days: int = 20) -> DataFrame:
    """Needs session_id."""
    df = df.withColumns({"volume_is_missing": flag(col("volume").isNull()), "_v": F.coalesce("volume", F.lit(0.0)), "_mod": F.hour("close_time") * 60 + F.minute("close_time")})
    r = col("_range")
    df = df.withColumns({"buy_pressure": ((col("close") - col("low")) - (col("high") - col("close"))) / (r + EPS), "_tp": (col("high") + col("low") + col("close")) / 3})
    df = df.withColumns({f"volume_ma_{n}": mean("_v", n) for n in means} | {"_bpv": col("buy_pressure") * col("_v"), "_sv": F.signum(col("_d")) * col("_v")})
    tod = W.partitionBy("symbol", "_mod").orderBy("close_time").rowsBetween(-days, -1)
    sess = W.partitionBy("symbol", "session_id").orderBy("close_time").rowsBetween(W.unboundedPreceding, 0)
    pv, v = F.sum(col("_tp") * col("_v")).over(sess), F.sum("_v").over(sess)
    usual = F.when(F.count("_v").over(tod) >= max(3, days // 4), F.expr("percentile(_v, 0.5)").over(tod))
    df = df.withColumns({"volume_ratio": col("_v") / (col(f"volume_ma_{min(means)}") + EPS), "relative_volume_tod": col("_v") / (usual + EPS), "_f20": total("_bpv", 20), "_f50": total("_bpv", 50)})
    out = {"volume_zscore_50": zscore("_v", 50), "volume_expansion": mean("_v", 5) / (col(f"volume_ma_{max(means)}") + EPS), "volume_weighted_buy_pressure": col("buy_pressure") * col("volume_ratio")}
    out |= {"cvd_proxy_20": zscore("_f20", 50), "cvd_proxy_50": zscore("_f50", 50)}
    out |= {"obv_slope_20": F.when(lag("close", 20).isNotNull(), F.sum("_sv").over(rows(20)) / (total("_v", 20) + EPS))}
    df = df.withColumns(out | {"dist_vwap_atr": (col("close") - F.when(v > 0, pv / (v + EPS)).otherwise(col("_tp"))) / (col("atr") + EPS)})
    return df.withColumn("volume_compression", 1 / (col("volume_expansion") + EPS))


def trend(df: DataFrame, emas=(20, 50, 100, 200), regressions=(20, 50), hurst: int = 100) -> DataFrame:
    up, down = col("high") - lag("high"), lag("low") - col("low")
    df = df.withColumns({"_gain": F.greatest(col("_d"), F.lit(0.0)), "_loss": F.greatest(-col("_d"), F.lit(0.0)), "_up": up, "_dn": down})
    df = df.withColumns({"_gain": F.when(col("_d").isNotNull(), col("_gain")), "_loss": F.when(col("_d").isNotNull(), col("_loss"))})
    df = df.withColumns({"_pdm": F.when((col("_up") > col("_dn")) & (col("_up") > 0), col("_up")).otherwise(0.0), "_mdm": F.when((col("_dn") > col("_up")) & (col("_dn") > 0), col("_dn")).otherwise(0.0)})
    df = smooth(df, *(ema(f"_ema_{n}", "close", n) for n in emas), ema("_fast", "close", 12), ema("_slow", "close", 26), wilder("_g", "_gain", 14), wilder("_l", "_loss", 14), wilder("_p", "_pdm", 14), wilder("_m", "_mdm", 14), wilder("_t", "_tr", 14))
    a = col("atr")
    df = df.withColumns({"_macd": col("_fast") - col("_slow"), "rsi_14": 100 - 100 / (1 + col("_g") / (col("_l") + EPS)), "di_plus_14": 100 * col("_p") / (col("_t") + EPS), "di_minus_14": 100 * col("_m") / (col("_t") + EPS)})
    df = df.withColumn("_dx", 100 * F.abs(col("di_plus_14") - col("di_minus_14")) / (col("di_plus_14") + col("di_minus_14") + EPS))
    df = smooth(df, ema("_signal", "_macd", 9), wilder("adx_14", "_dx", 14))
    out = {}
    for n in emas:
        e = col(f"_ema_{n}")
        out |= {f"dist_ema_{n}_atr": (col("close") - e) / (a + EPS), f"ema_slope_{n}": (e - lag(e, 5)) / (5 * a + EPS)}
    pairs = list(combinations(sorted(emas), 2))
    known = F.lit(True)
    for n in emas:
        known = known & col(f"_ema_{n}").isNotNull()
    out["ema_stack_score"] = F.when(known, sum((F.when(col(f"_ema_{i}") > col(f"_ema_{j}"), 1.0).otherwise(-1.0) for i, j in pairs), F.lit(0.0)) / len(pairs))
    e = [col(f"_ema_{n}") for n in sorted(emas)]
    out |= {"ema_20_50_spread_atr": (e[0] - e[1]) / (a + EPS), "ema_50_200_spread_atr": ((e[1] if len(e) > 2 else e[0]) - e[-1]) / (a + EPS)}
    out |= {"di_diff": (col("di_plus_14") - col("di_minus_14")) / (col("di_plus_14") + col("di_minus_14") + EPS), "adx_slope_5": col("adx_14") - lag("adx_14", 5)}
    out |= {"macd_hist_atr": (col("_macd") - col("_signal")) / (a + EPS), "rsi_slope_5": col("rsi_14") - lag("rsi_14", 5)}
    bull = flag(col("close") <= low("close", 20)) * (1 - flag(col("rsi_14") <= low("rsi_14", 20)))
    bear = flag(col("close") >= high("close", 20)) * (1 - flag(col("rsi_14") >= high("rsi_14", 20)))
    out["rsi_divergence_20"] = F.when(low("close", 20).isNotNull(), bull - bear)
    hh, ll = high("high", 14), low("low", 14)
    tp = (col("high") + col("low") + col("close")) / 3
    out |= {"stoch_k_14": 100 * (col("close") - ll) / (hh - ll + EPS), "williams_r_14": (100 - 100 * (hh - col("close")) / (hh - ll + EPS)) / 100}
    df = df.withColumns(out | {"_tp3": tp, "_ad": F.abs(col("_d")), "_lr8": F.log("close") - F.log(lag("close", 8)), "_lr1": F.log("close") - F.log("_c1")})
    df = df.withColumn("_tpd", F.abs(col("_tp3") - mean("_tp3", 20)))
    out = {"stoch_d_3": mean("stoch_k_14", 3), "cci_20_norm": (col("_tp3") - mean("_tp3", 20)) / (0.015 * mean("_tpd", 20) + EPS) / 100}
    for n in regressions:
        slope, r2 = linreg("close", n)
        out |= {f"linreg_slope_{n}_atr": slope / (a + EPS), f"linreg_r2_{n}": r2}
    out["efficiency_ratio_20"] = F.abs(col("close") - lag("close", 20)) / (total("_ad", 20) + EPS)
    ratio = rolling(F.var_pop, "_lr8", hurst) / (8 * rolling(F.var_pop, "_lr1", hurst) + EPS)
    out[f"hurst_vr_{hurst}"] = 0.5 + F.log(F.greatest(ratio, F.lit(1e-6))) / (2 * math.log(8))
    return df.withColumns({k: F.when(ratio.isNotNull(), v) if k.startswith("hurst") else v for k, v in out.items()})


def patterns(df: DataFrame) -> DataFrame:
    a, b, r, cl, o = col("atr"), col("_body"), col("_range"), col("close"), col("open")
    b1, o1, c1 = lag("_body"), lag("open"), lag("close")
    before = series().rowsBetween(-20, -1)
    full = F.count("high").over(before) == 20
    df = df.withColumns({"_ph": F.when(full, F.max("high").over(before)), "_pl": F.when(full, F.min("low").over(before)), "_r20": mean("_range", 20), "_up5": F.greatest(b, F.lit(0.0)), "_dn5": F.greatest(-b, F.lit(0.0)), "_pos": flag(b > 0)})
    df = df.withColumns({"_penl": (col("_pl") - col("low")) / (a + EPS), "_penh": (col("high") - col("_ph")) / (a + EPS)})
    engulf = squash(F.abs(b) / (F.abs(b1) + EPS) - 1) * squash(F.abs(b) / (a + EPS))
    top, bottom, pos = F.greatest(o, cl), F.least(o, cl), (cl - col("low")) / (r + EPS)
    upper, lower, thin = (col("high") - top) / (r + EPS), (bottom - col("low")) / (r + EPS), 1 - clip(F.abs(b) / (r + EPS), 0, 1)
    push = 0.5 + 0.5 * squash(r / (col("_r20") + EPS) - 1)
    out = {
        "engulf_bull_strength": F.when((b > 0) & (b1 < 0) & (cl > o1) & (o < c1), engulf), "engulf_bear_strength": F.when((b < 0) & (b1 > 0) & (cl < o1) & (o > c1), engulf),
        "pinbar_bull_strength": lower * thin * squash(r / (a + EPS)), "pinbar_bear_strength": upper * thin * squash(r / (a + EPS)),
        "rejection_bull_strength": lower * pos * squash(r / (a + EPS), 1.5), "rejection_bear_strength": upper * (1 - pos) * squash(r / (a + EPS), 1.5),
        "breakout_bull_strength": F.when(cl > col("_ph"), squash((cl - col("_ph")) / (a + EPS), 0.5) * push), "breakout_bear_strength": F.when(cl < col("_pl"), squash((col("_pl") - cl) / (a + EPS), 0.5) * push),
        "momentum_bull_strength": squash(total("_up5", 5) / (5 * a + EPS), 0.3) * mean("_pos", 5), "momentum_bear_strength": squash(total("_dn5", 5) / (5 * a + EPS), 0.3) * (1 - mean("_pos", 5)),
        "double_retest_bull_strength": F.when(F.abs(col("low") - col("_pl")) / (a + EPS) < 0.5, squash(F.max("_penl").over(before) - col("_penl"), 0.5)),
        "double_retest_bear_strength": F.when(F.abs(col("high") - col("_ph")) / (a + EPS) < 0.5, squash(F.max("_penh").over(before) - col("_penh"), 0.5)),
        "compression_strength": 1 - rank_pct("_range", 7, 7),
    }
    known = {k: F.when(F.col("atr").isNotNull() | F.lit(k == "compression_strength"), v) for k, v in out.items()}
    return df.withColumns({k: F.coalesce(clip(v, 0, 1), F.lit(0.0)) for k, v in known.items()})


def clock(df: DataFrame, minutes: int, vol_days: int = 20, gap_flag: int = 12, causal: bool = False) -> DataFrame:
    """Time and session features. causal replaces the statistics of whole series by trailing ones."""
    t = col("close_time")
    mod, two_pi = F.hour(t) * 60 + F.minute(t), 2 * math.pi
    out = {}
    for name, x in (("hour", F.hour(t) / 24), ("minute_of_day", mod / 1440), ("dow", F.weekday(t) / 7), ("month", F.month(t) / 12)):
        out |= {f"{name}_sin": F.sin(two_pi * x), f"{name}_cos": F.cos(two_pi * x)}
    late = F.dayofmonth(t) >= 28
    out |= {"day_of_week": F.weekday(t).cast("double"), "is_month_end": flag(late), "is_quarter_end": flag(late & (F.month(t) % 3 == 0))}
    out |= {f"session_is_{n}": flag(col("session") == s) for n, s in (("asia", "ASIA"), ("london", "LONDON"), ("ny", "NY"), ("london_ny_overlap", "LONDON_NY_OVERLAP"), ("off", "OFF"))}
    own = W.partitionBy("symbol", "session_id").orderBy("close_time")
    run = own.rowsBetween(W.unboundedPreceding, 0)
    out |= {"bars_since_session_open": (F.row_number().over(own) - 1).cast("double"), "_rh": F.max("high").over(run), "_rl": F.min("low").over(run), "_so": F.first("open").over(run)}
    gap = F.coalesce(t.cast("long") - lag("close_time").cast("long") > minutes * 60, F.lit(True))
    df = df.withColumns(out | {"_gap": gap.cast("int")}).withColumn("_island", F.sum("_gap").over(series().rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("bars_since_gap", (F.row_number().over(W.partitionBy("symbol", "_island").orderBy("close_time")) - 1).cast("double"))
    if causal:
        df = df.withColumn("_size", col("bars_since_session_open") + 1)
        df = df.withColumns({"_usual": F.expr("percentile(CASE WHEN _size > 1 THEN _size END, 0.5)").over(rows(5 * vol_days)), "_labels": F.lit(5)})
    else:
        # A few rows for each symbol, from the sizes of its sessions: the median over bars weighs each session by its size.
        sizes = df.groupBy("symbol", "session_id", "session").agg(F.count("*").alias("_part"))
        whole = sizes.groupBy("symbol", "session_id").agg(F.sum("_part").alias("_size"))
        usual = whole.where("_size > 1").groupBy("symbol").agg(F.expr("percentile(_size, 0.5, _size)").alias("_usual"))
        labels = sizes.groupBy("symbol").agg(F.countDistinct("session").alias("_labels"))
        df = df.join(labels.join(usual, "symbol", "left"), "symbol")
    label = W.partitionBy("symbol", "session").orderBy("close_time")
    # The window of a label's bars depends on how many labels there are, five at most.
    usual, total_bars = F.lit(None).cast("double"), vol_days * 1440 // minutes
    for n in range(1, 6):
        size = max(2, total_bars // n)
        old = label.rowsBetween(-size, -1)
        usual = F.when((col("_labels") == n) & (F.count("atr").over(old) >= max(10, size // 10)), F.avg("atr").over(old)).otherwise(usual)
    df = df.withColumn("_typical", usual)
    a, pos = col("atr"), col("bars_since_session_open")
    df = df.withColumn("session_progress", clip(pos / (col("_usual") + EPS), 0, 1))
    return df.withColumns({
        "is_session_first_hour": flag(pos < max(1, 60 // minutes)), "is_session_last_hour": flag(col("session_progress") > 0.85), "session_range_atr": (col("_rh") - col("_rl")) / (a + EPS),
        "session_atr_ratio": a / (col("_typical") + EPS), "session_trend": F.tanh((col("close") - col("_so")) / (a + EPS) / 3), "is_post_gap": flag(col("bars_since_gap") < gap_flag),
    })


def last_values(df: DataFrame, values: dict[str, Column], strict: Collection[str] = (), chunk_rows: int | None = None, steps: Steps | None = None) -> DataFrame:
    """df with the last value that is not null of each of values so far; of the names in strict, before each bar. With
    chunk_rows by a scan whose rows are written, as what follows reads them more than once."""
    if chunk_rows:
        return steps.cut(scan.carried(df.withColumn(scan.BUCKET, F.floor(col("rn") / chunk_rows)), values, ["close_time"], strict=strict).drop(scan.BUCKET))
    until = lambda n: series().rowsBetween(W.unboundedPreceding, -1 if n in strict else 0)
    return df.withColumns({n: F.last(v, True).over(until(n)) for n, v in values.items()})


def structure(df: DataFrame, k: int = 2, memory: int = 6, span: int = 50, chunk_rows: int | None = None) -> DataFrame:
    """Swings, trend of swings, breaks of structure and shifts: the state as last events. With chunk_rows no window is over
    a whole series: events are carried over chunks by scans, however far back they lie."""
    w, given, steps = 2 * k + 1, df.columns, Steps(df.sparkSession)
    held = lambda df, values, strict=(): last_values(df, values, strict, chunk_rows, steps)

    def bounded(df: DataFrame) -> DataFrame:
        swings = {"_H": F.when(lag("high", k) >= high("high", w), lag("high", k)), "_L": F.when(lag("low", k) <= low("low", w), lag("low", k))}
        return df.withColumns(swings | {"_xh": high("high", span), "_xl": low("low", span)})

    df = in_chunks(df, bounded, max(w, span), chunk_rows) if chunk_rows else bounded(df)
    at = {f"{n}rn": F.when(col(x).isNotNull(), col("rn") - k) for n, x in (("_h", "_H"), ("_l", "_L"))}
    df = held(df, {"_pH": col("_H"), "_pL": col("_L"), "_lh": col("_H"), "_ll": col("_L")} | at, ("_pH", "_pL"))
    both_h, both_l = col("_H").isNotNull() & col("_pH").isNotNull(), col("_L").isNotNull() & col("_pL").isNotNull()
    df = df.withColumns({
        "swing_high_flag": flag(col("_H").isNotNull()), "swing_low_flag": flag(col("_L").isNotNull()),
        "_hh": F.when(both_h, flag(col("_H") > col("_pH"))), "_lhf": F.when(both_h, flag(col("_H") <= col("_pH"))), "_hl": F.when(both_l, flag(col("_L") > col("_pL"))), "_llf": F.when(both_l, flag(col("_L") <= col("_pL"))),
        "_eh": F.when(both_h, F.when(col("_H") > col("_pH"), 1).otherwise(-1)), "_el": F.when(both_l, F.when(col("_L") > col("_pL"), 1).otherwise(-1)),
    })
    df = last_events(df, memory, chunk_rows, steps)
    df = held(df, {"hh": col("_hh"), "hl": col("_hl"), "lh": col("_lhf"), "ll": col("_llf")}).fillna(0.0, ["hh", "hl", "lh", "ll"])
    up, dn = flag(col("close") > col("_lh")), flag(col("close") < col("_ll"))
    df = df.withColumns({
        "structure_direction": F.when((col("hh") == 1) & (col("hl") == 1), 1.0).when((col("lh") == 1) & (col("ll") == 1), -1.0).when(col("_cnt") >= 2, F.signum(col("_sum").cast("double"))).otherwise(0.0),
        "structure_strength": F.when(col("_cnt") > 0, F.abs("_sum") / col("_cnt")), "bos_bull": up, "bos_bear": dn, "_b": F.when(up == 1, 1).when(dn == 1, -1),
        "_bd": F.when(up == 1, col("close") - col("_lh")).when(dn == 1, col("_ll") - col("close")),
    })
    df = held(df, {"_pb": col("_b"), "_bdl": col("_bd"), "_brn": F.when(col("_b").isNotNull(), col("rn"))}, ("_pb",)).fillna(0, ["_pb"])
    df = df.withColumns({"mss_bull": flag((col("_b") == 1) & (col("_pb") <= 0)), "mss_bear": flag((col("_b") == -1) & (col("_pb") >= 0))})
    shift = (col("mss_bull") == 1) | (col("mss_bear") == 1)
    df = held(df, {"_msd": F.when(shift, col("_bd")), "_mrn": F.when(shift, col("rn"))})
    a, age = col("atr"), lambda x: (col("rn") - col(x)).cast("double")
    width, pos = col("_xh") - col("_xl"), (col("close") - col("_xl")) / (col("_xh") - col("_xl") + EPS)
    score = (1 - squash(width / (10 * a + EPS))) * (1 - 2 * F.abs(pos - 0.5))
    return df.withColumns({
        "bos_age": age("_brn"), "mss_age": age("_mrn"), "last_swing_high_age": age("_hrn"), "last_swing_low_age": age("_lrn"),
        "last_swing_high_dist_atr": (col("close") - col("_lh")) / (a + EPS), "last_swing_low_dist_atr": (col("close") - col("_ll")) / (a + EPS),
        "bos_strength": squash(col("_bdl") / (a + EPS)), "mss_strength": squash(col("_msd") / (a + EPS)), "range_high_dist_atr": (col("_xh") - col("close")) / (a + EPS), "range_low_dist_atr": (col("close") - col("_xl")) / (a + EPS),
        "range_width_atr": width / (a + EPS), "range_position": pos, "consolidation_score": clip(F.when(width.isNotNull() & a.isNotNull(), score), 0, 1),
    }).select(*given, *STRUCTURE)


STRUCTURE = (
    "swing_high_flag", "swing_low_flag", "last_swing_high_dist_atr", "last_swing_low_dist_atr", "last_swing_high_age", "last_swing_low_age", "hh", "hl", "lh", "ll", "structure_direction", "structure_strength",
    *(f"{x}_{n}" for x in ("bos", "mss") for n in ("bull", "bear", "strength", "age")), "range_high_dist_atr", "range_low_dist_atr", "range_width_atr", "range_position", "consolidation_score",
)


def last_events(df: DataFrame, memory: int, chunk_rows: int | None, steps: Steps) -> DataFrame:
    """df with the sum and number of the last memory events, _eh before _el in a bar."""
    both_h, both_l = col("_eh").isNotNull(), col("_el").isNotNull()
    value, number = F.coalesce("_eh", F.lit(0)) + F.coalesce("_el", F.lit(0)), both_h.cast("int") + both_l.cast("int")
    if not chunk_rows:
        # The last events are those of the bars in a range of numbers, less the high of the first bar in it where both its
        # events count and one is too many.
        df = df.withColumn("_n", F.sum(number).over(series().rowsBetween(W.unboundedPreceding, 0)))
        last = W.partitionBy("symbol").orderBy("_n")
        spare = F.sum(F.when(both_h & both_l, F.col("_eh"))).over(last.rangeBetween(-(memory - 1), -(memory - 1)))
        return df.withColumns({"_sum": F.sum(value).over(last.rangeBetween(-(memory - 1), 0)) - F.coalesce(spare, F.lit(0)), "_cnt": F.least("_n", F.lit(memory))})
    # The sum of the last events is that of all so far less that of all up to the event so many before.
    df = scan.totals(df.withColumn(scan.BUCKET, F.floor(col("rn") / chunk_rows)), {"_n": number.cast("long"), "_all": value.cast("long")}, ["close_time"])
    df = steps.cut(df.drop(scan.BUCKET))
    one = lambda number, total: F.struct(number.alias("_old"), total.alias("_then"))
    each = F.when(both_h & both_l, F.array(one(col("_n") - 1, col("_all") - col("_el")), one(col("_n"), col("_all")))).when(both_h | both_l, F.array(one(col("_n"), col("_all"))))
    df = df.withColumn("_old", col("_n") - memory).join(df.select("symbol", F.inline(each)), ["symbol", "_old"], "left")
    return df.withColumns({"_sum": col("_all") - F.coalesce("_then", F.lit(0)), "_cnt": F.least("_n", F.lit(memory))})


LEVELS = tuple(f"{x}_{s}" for x in ("prev_day", "prev_week", "asia", "london", "ny", "session") for s in ("high", "low"))


def liquidity(df: DataFrame, trading_day, sweep_bars: int = 12, tolerance: float = 0.1, cluster: float = 0.5, span: int = 50) -> DataFrame:
    """Distances to reference levels, sweeps of levels and what follows. trading_day is a Column function of close_time."""
    from barlake.operators.asof import completed_levels

    day = trading_day(col("close_time"))
    df = df.withColumns({"_day": day, "_week": F.date_trunc("week", day).cast("date")})
    run = W.partitionBy("symbol", "session_id").orderBy("close_time").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"session_high": F.max("high").over(run), "session_low": F.min("low").over(run)})
    keys = {"prev_day": col("_day"), "prev_week": col("_week")} | {n: F.when(col(f"in_{n}"), col("session_id")) for n in ("asia", "london", "ny")}
    df = completed_levels(df, keys)
    a, cl = col("atr"), col("close")
    df = df.withColumns({f"dist_{x}_atr": (cl - col(x)) / (a + EPS) for x in LEVELS} | {"_off": F.array_compact(F.array(*((col(x) - cl) / (a + EPS) for x in LEVELS)))} | {f"_lag_{x}": lag(x) for x in LEVELS[:10]})
    lags = F.array(*(col(f"_lag_{x}") for x in LEVELS[:10]))
    over = F.filter(lags, lambda x: (col("high") > x + tolerance * a) & (cl < x))
    under = F.filter(lags, lambda x: (col("low") < x - tolerance * a) & (cl > x))
    df = df.withColumns({
        "nearest_level_above_atr": F.array_min(F.filter("_off", lambda x: x > 0)), "nearest_level_below_atr": F.array_min(F.transform(F.filter("_off", lambda x: x < 0), lambda x: -x)),
        "level_cluster_density": F.when(F.size("_off") > 0, F.size(F.filter("_off", lambda x: F.abs(x) <= cluster)) / F.size("_off")), "_over": over, "_under": under,
        "_eqh": F.when(high("high", span).isNotNull(), flag(col("high") >= high("high", span) - tolerance * a)), "_eql": F.when(low("low", span).isNotNull(), flag(col("low") <= low("low", span) + tolerance * a)),
    })
    # Array comparisons with a null ATR are null, so nothing is swept before the ATR is there.
    df = df.withColumns({"sweep_high": flag(F.size("_over") > 0), "sweep_low": flag(F.size("_under") > 0)})
    deep_h, deep_l = (col("high") - F.array_min("_over")) / (a + EPS), (F.array_max("_under") - col("low")) / (a + EPS)
    back_h, back_l = (col("high") - cl) / (col("_range") + EPS), (cl - col("low")) / (col("_range") + EPS)
    df = df.withColumn("sweep_strength", F.coalesce(F.tanh(F.greatest(deep_h, deep_l)) * F.when(col("sweep_high") == 1, back_h).when(col("sweep_low") == 1, back_l), F.lit(0.0)))
    swept = (col("sweep_high") == 1) | (col("sweep_low") == 1)
    event = F.struct(col("rn").alias("rn"), F.when(col("sweep_high") == 1, 1.0).otherwise(-1.0).alias("dir"), cl.alias("close"), col("sweep_strength").alias("strength"))
    df = df.withColumn("_s", F.last(F.when(swept, event), True).over(series().rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("sweep_age", (col("rn") - col("_s.rn")).cast("double")).withColumn("_live", F.coalesce(col("sweep_age") <= sweep_bars, F.lit(False)))
    follow = F.tanh(F.greatest(-col("_s.dir") * (cl - col("_s.close")) / (a + EPS), F.lit(0.0)))
    return df.withColumns({
        "sweep_direction": F.when(col("_live"), col("_s.dir")).otherwise(0.0), "stop_hunt_score": F.when(col("_live"), col("_s.strength") * follow).otherwise(0.0), "rejection_after_sweep": F.when(col("_live"), follow).otherwise(0.0),
        "equal_highs_count_50": total("_eqh", span), "equal_lows_count_50": total("_eql", span),
    })


def running(df: DataFrame, base: int, targets=(15, 60, 240)) -> DataFrame:
    """The coarse bar in progress, up to and with each bar. df has open_time."""
    from barlake.timeframes import floor_time

    names = {15: "15m", 60: "1h", 240: "4h"}
    for m in targets:
        n = names.get(m, f"{m}m")
        df = df.withColumn("_cell", floor_time(col("open_time"), m))
        w = W.partitionBy("symbol", "_cell").orderBy("close_time")
        run = w.rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({"_ch": F.max("high").over(run), "_cl": F.min("low").over(run), "_co": F.first("open").over(run), "_cn": F.row_number().over(w)})
        a = col("atr")
        df = df.withColumns({
            f"running_progress_{n}": clip(col("_cn") / (m / base), 0, 1), f"running_range_atr_{n}": (col("_ch") - col("_cl")) / (a + EPS),
            f"running_position_{n}": (col("close") - col("_cl")) / (col("_ch") - col("_cl") + EPS), f"running_return_atr_{n}": (col("close") - col("_co")) / (a + EPS),
        })
    return df


def cross(df: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Agreement of the EMA stacks of coarse frames, suffixed by name, and ratios of ATR shares. frames: minutes by name."""
    stacks = [(col(f"ema_stack_score_{n}"), math.sqrt(m)) for n, m in frames.items()]
    signs = F.array_compact(F.array(*(F.signum(s) for s, _ in stacks)))
    agree = F.when(F.size(signs) > 0, F.aggregate(signs, F.lit(0.0), lambda x, y: x + y) / F.size(signs))
    score = sum((s * w for s, w in stacks), F.lit(0.0)) / sum(w for _, w in stacks)
    df = df.withColumns({"htf_trend_agreement": agree, "htf_alignment_score": score})
    df = df.withColumn("htf_base_agreement", col("htf_trend_agreement") * F.signum(col("ema_stack_score")))
    return df.withColumns({f"tf_vol_ratio_base_{n}": col("atr_pct") / (col(f"atr_pct_{n}") + EPS) for n in frames})


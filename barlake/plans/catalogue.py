"""Registered queries over the supplied tables, and the DuckDB SQL that states what each computes.

Bars come from events: 15-minute bars at a price of 100 + value for indicators, so that logarithms are safe.
Numbers are rounded on both sides, as sums in another order differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.bars import ticks_to_bars
from barlake.calendars import SESSIONS, Calendar, classify
from barlake.functions import groups as G
from barlake.functions import rolling as R
from barlake.operators import quality as Q
from barlake.operators.asof import asof, completed_levels
from barlake.operators.chunks import in_chunks
from barlake.operators.resample import resample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def bars(spark: SparkSession, d: str, minutes: int = 15, by_type: bool = False) -> DataFrame:
    return ticks_to_bars(events(spark, d), minutes, price=F.col("value") + 100, symbol=F.col("event_type") if by_type else None)


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Bars with planted faults: each event is a row, high and low are off on some, stamps repeat and miss the grid."""
    e, i = events(spark, d), F.col("event_id")
    t = F.timestamp_micros(F.floor(F.unix_micros("ts") / 300_000_000) * 300_000_000 + F.when(i % 50 == 7, 60_000_000).otherwise(0))
    v = F.col("value")
    return e.select(F.lit("ALL").alias("symbol"), t.alias("open_time"), (t + F.expr("INTERVAL 5 MINUTES")).alias("close_time"), v.alias("open"), F.when(i % 40 == 3, v - 1).otherwise(v + 1).alias("high"), (v - 1).alias("low"), F.when(i % 97 == 5, F.lit(None)).otherwise(v).alias("close"), F.when(i % 60 == 9, 0.0).otherwise(F.when(i % 90 == 11, -1.0).otherwise(5.0)).alias("volume"), i.alias("row_no"))


def told(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    """symbol, close_time as text, and rounded values."""
    return df.select("symbol", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("close_at"), *((F.round(F.col(n).cast("double"), digits) + 0.0).alias(n) for n in names))


# SQL: events and bars. Each piece is a common table expression that later ones build on.
EV = "ev AS (SELECT event_id, ts, event_type, value FROM events)"


def bars_sql(minutes: int = 15, name: str = "b", price: str = "100 + value", symbol: str = "'ALL'") -> str:
    return f"""{name} AS (SELECT {symbol} AS symbol, time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01') AS open_time,
  time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01') + INTERVAL {minutes} MINUTE AS close_time,
  arg_min({price}, event_id) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, event_id) AS close, CAST(count(value) AS DOUBLE) AS volume
  FROM ev GROUP BY ALL)"""


NUM = """n AS (SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS c1, high - low AS rg, close - open AS bd FROM b WINDOW w AS (PARTITION BY symbol ORDER BY close_time)),
s AS (SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, close - c1 AS d FROM n)"""
ATR = """atr_r AS (
  SELECT rn, tr AS y FROM s WHERE rn = 0 UNION ALL
  SELECT s.rn, y * (1 - 1.0 / 14) + s.tr / 14 FROM atr_r JOIN s ON s.rn = atr_r.rn + 1),
a AS (SELECT s.*, CASE WHEN s.rn >= 13 THEN y END AS atr FROM s JOIN atr_r USING (rn))"""
BASE = f"WITH RECURSIVE {EV}, {bars_sql()}, {NUM}"
WITH_ATR = f"{BASE}, {ATR}"
AT = "strftime(close_time, '%Y-%m-%d %H:%M:%S') AS close_at"
WIN = "(PARTITION BY symbol ORDER BY close_time ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def over(f: str, x: str, n: int, least: int | None = None) -> str:
    """A guarded rolling aggregate in SQL."""
    w = WIN.format(n - 1)
    return f"(CASE WHEN count({x}) OVER {w} >= {least or n} THEN {f}({x}) OVER {w} END)"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY close_time)"


def rounded(cols: dict[str, str], digits: int = DIGITS) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {k}" for k, v in cols.items())


def final(cols: dict[str, str], source: str, digits: int = DIGITS) -> str:
    return f"SELECT symbol, {AT}, {rounded(cols, digits)} FROM {source}"


E = "1e-12"

# --- bars, resampling, calendar ---------------------------------------------------------------------------------------


@query(f"WITH {EV}, {bars_sql(5)} " + final({x: x for x in ("open", "high", "low", "close", "volume")}, "b"))
def ticks_to_bars_5m(spark, d):
    return told(bars(spark, d, 5), "open", "high", "low", "close", "volume")


@query(f"WITH {EV}, {bars_sql(60, symbol='event_type')} " + final({x: x for x in ("open", "high", "low", "close", "volume")}, "b"))
def bars_by_type_1h(spark, d):
    return told(bars(spark, d, 60, True), "open", "high", "low", "close", "volume")


@query(f"WITH {EV}, {bars_sql(5)} " + final({x: x for x in ("open", "high", "low", "close", "volume")}, "b WHERE close_time > TIMESTAMP '2024-01-05 00:00:00'"))
def bars_from_files(spark, d):
    """Bars that went to files of two dialects, read back by the bars source in ranges of bytes, with a filter on times."""
    from barlake.sources.datasource import register
    from barlake.sources.scratch import folder

    register(spark)
    b, root = bars(spark, d, 5), folder(spark, "dialects")
    even, prices = F.hour("open_time") % 2 == 0, ("open", "high", "low", "close", "volume")
    stamp = lambda form, name: F.date_format("open_time", form).alias(name)
    b.where(even).select(stamp("yyyy-MM-dd HH:mm:ss", "datetime"), *prices).write.option("header", True).option("sep", ";").csv(f"{root}/named")
    b.where(~even).select(stamp("yyyy.MM.dd", "d"), stamp("HH:mm:ss", "t"), *(F.regexp_replace(F.col(x).cast("string"), r"\.", ",").alias(x) for x in prices)).write.option("sep", "\t").csv(f"{root}/plain")
    read = lambda name, **options: spark.read.format("bars").options(path=f"{root}/{name}", minutes=5, splitbytes=20_000, **options).load()
    both = read("named").unionByName(read("plain", decimal=","))
    return told(both.where(F.col("close_time") > F.lit("2024-01-05 00:00:00").cast("timestamp")), *prices)


def resample_sql(minutes: int, offset: int = 0) -> str:
    t = f"time_bucket(INTERVAL {minutes} MINUTE, open_time, TIMESTAMP '2000-01-01' + INTERVAL {offset} MINUTE)"
    return f"""WITH {EV}, {bars_sql(5)}, r AS (SELECT symbol, {t} + INTERVAL {minutes} MINUTE AS close_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
  sum(volume) AS volume, count(*) AS n_base_bars FROM b GROUP BY symbol, {t}),
q AS (SELECT *, (SELECT min(n_base_bars) FROM (SELECT n_base_bars, count(*) AS k FROM r GROUP BY 1 QUALIFY k = max(k) OVER ())) AS m FROM r WHERE close_time <= (SELECT max(close_time) FROM b))
""" + final({**{x: x for x in ("open", "high", "low", "close", "volume", "n_base_bars")}, "is_partial": "CAST(n_base_bars / m < 0.5 AS INTEGER)"}, "q")


RESAMPLED = ("open", "high", "low", "close", "volume", "n_base_bars", "is_partial")


@query(resample_sql(15))
def resample_15m(spark, d):
    return told(resample(bars(spark, d, 5), 5, 15), *RESAMPLED)


@query(resample_sql(60))
def resample_1h(spark, d):
    return told(resample(bars(spark, d, 5), 5, 60), *RESAMPLED)


@query(resample_sql(240, 120))
def resample_4h_offset(spark, d):
    return told(resample(bars(spark, d, 5), 5, 240, offset=120), *RESAMPLED)


NY = "timezone('America/New_York', timezone('UTC', {}))"
DAY = "date_trunc('day', " + NY.format("open_time") + " - INTERVAL 17 HOUR)"


@query(f"""WITH {EV}, {bars_sql(5)}, k AS (SELECT *, {DAY} AS day FROM b),
r AS (SELECT symbol, timezone('UTC', timezone('America/New_York', day + INTERVAL 41 HOUR)) AS close_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS n_base_bars FROM k GROUP BY symbol, day)
""" + final({x: x for x in RESAMPLED[:-1]}, "r WHERE close_time <= (SELECT max(close_time) FROM b)"))
def resample_1d_ny_anchor(spark, d):
    return told(resample(bars(spark, d, 5), 5, 1440), *RESAMPLED[:-1])


LOCAL = NY.format("{}")


def open_sql(t: str) -> str:
    x = LOCAL.format(t)
    day, minute = f"(isodow({x}) - 1)", f"(hour({x}) * 60 + minute({x}))"
    return f"(({day} * 1440 + {minute} >= 9720 OR {day} * 1440 + {minute} < 6780) AND NOT ({minute} >= 1020 AND {minute} < 1080 AND {day} NOT IN (6, 4)))".replace("6780", str(4 * 1440 + 1020)).replace("9720", str(6 * 1440 + 1080))


@query(f"WITH {EV}, {bars_sql()} SELECT symbol, {AT}, {open_sql('open_time')} AS is_open, CAST(" + LOCAL.format("close_time") + " AS DATE) + CAST(CASE WHEN hour(" + LOCAL.format("close_time") + ") >= 18 THEN 1 ELSE 0 END AS INTEGER) AS trading_day FROM b")
def calendar_is_open(spark, d):
    c = Calendar()
    return bars(spark, d).select("symbol", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("close_at"), c.is_open(F.col("open_time")).alias("is_open"), c.trading_day(F.col("close_time")).alias("trading_day"))


def inside_sql(tz: str, a: int, b: int) -> str:
    x = f"timezone('{tz}', timezone('UTC', close_time))"
    return f"(hour({x}) * 60 + minute({x}) >= {a} AND hour({x}) * 60 + minute({x}) < {b} AND isodow({x}) <= 5)"


def sid_sql(name: str, tz: str) -> str:
    return f"'{name}:' || strftime(timezone('{tz}', timezone('UTC', close_time)), '%Y-%m-%d')"


SESSION_SQL = f"""ss AS (SELECT *, {inside_sql('Asia/Tokyo', 540, 1080)} AS in_asia, {inside_sql('Europe/London', 480, 990)} AS in_london, {inside_sql('America/New_York', 480, 1020)} AS in_ny FROM {{0}}),
se AS (SELECT *, CASE WHEN in_london AND in_ny THEN 'LONDON_NY_OVERLAP' WHEN in_ny THEN 'NY' WHEN in_london THEN 'LONDON' WHEN in_asia THEN 'ASIA' ELSE 'OFF' END AS session,
  CASE WHEN in_ny THEN {sid_sql('NY', 'America/New_York')} WHEN in_london THEN {sid_sql('LONDON', 'Europe/London')} WHEN in_asia THEN {sid_sql('ASIA', 'Asia/Tokyo')} ELSE 'OFF' END AS session_id FROM ss)"""


@query(f"WITH {EV}, {bars_sql()}, {SESSION_SQL.format('b')} SELECT symbol, {AT}, session, session_id, in_asia, in_london, in_ny FROM se")
def session_label(spark, d):
    return classify(bars(spark, d), SESSIONS).select("symbol", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("close_at"), "session", "session_id", "in_asia", "in_london", "in_ny")


# --- validation and cleaning ------------------------------------------------------------------------------------------

DIRTY = """dv AS (SELECT 'ALL' AS symbol, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') + CASE WHEN event_id % 50 = 7 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END AS open_time, event_id AS row_no, value AS open,
  CASE WHEN event_id % 40 = 3 THEN value - 1 ELSE value + 1 END AS high, value - 1 AS low, CASE WHEN event_id % 97 = 5 THEN NULL ELSE value END AS close,
  CASE WHEN event_id % 60 = 9 THEN 0.0 WHEN event_id % 90 = 11 THEN -1.0 ELSE 5.0 END AS volume FROM events),
v AS (SELECT *, open_time + INTERVAL 5 MINUTE AS close_time FROM dv),
vb AS (SELECT *, lag(close_time) OVER (ORDER BY row_no) > close_time AS back, row_number() OVER (PARTITION BY close_time ORDER BY row_no) > 1 AS copy,
  coalesce(high < low OR high < open OR high < close OR low > open OR low > close, false) AS bad, epoch(close_time)::BIGINT % 300 <> 0 AS off, (open <= 0 OR high <= 0 OR low <= 0 OR coalesce(close <= 0, false)) AS nonpos FROM v)"""


@query(f"""WITH {DIRTY}, c AS (SELECT count(*) FILTER (copy) AS duplicate_timestamp, count(*) FILTER (back) AS non_monotonic, count(*) FILTER (off) AS off_grid, count(*) FILTER (close IS NULL) AS null_value,
  count(*) FILTER (nonpos) AS non_positive_price, count(*) FILTER (bad) AS ohlc_inconsistent, count(*) FILTER (high = low) AS flat_bar, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (volume = 0) AS zero_volume FROM vb)
UNPIVOT c ON COLUMNS(*) INTO NAME issue VALUE n""")
def issue_counts(spark, d):
    return Q.issues(dirty(spark, d), 5)


@query(f"""WITH {EV}, {bars_sql(5, price='value')}, r AS (SELECT symbol, close_time, ln(CASE WHEN close > 0 THEN close END) - lag(ln(CASE WHEN close > 0 THEN close END)) OVER (ORDER BY close_time) AS ret FROM b),
m AS (SELECT quantile_cont(ret, 0.5) AS med FROM r), x AS (SELECT 1.4826 * quantile_cont(abs(ret - med), 0.5) AS mad FROM r, m WHERE ret IS NOT NULL)
SELECT symbol, {AT}, round(ret, 5) + 0.0 AS ret FROM r, m, x WHERE abs(ret - med) / mad > 3""")
def issue_extreme_returns(spark, d):
    b = ticks_to_bars(events(spark, d), 5).withColumn("row_no", F.col("close_time").cast("long"))
    return told(Q.extreme_returns(b, 3.0), "ret")


GRID = f"g AS (SELECT 'ALL' AS symbol, unnest(generate_series((SELECT min(open_time) FROM b), (SELECT max(open_time) FROM b), INTERVAL 5 MINUTE)) AS t), ms AS (SELECT g.* FROM g WHERE {open_sql('t')} AND t NOT IN (SELECT open_time FROM b)), ex AS (SELECT g.* FROM g WHERE {open_sql('t')})"


@query(f"WITH {EV}, {bars_sql(5)}, {GRID} SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S') AS missing_at FROM ms")
def gap_missing_bars(spark, d):
    return Q.missing_bars(bars(spark, d, 5), 5, Calendar()).select("symbol", F.date_format("open_time", "yyyy-MM-dd HH:mm:ss").alias("missing_at"))


@query(f"""WITH {EV}, {bars_sql(5)}, {GRID}, r AS (SELECT *, t - INTERVAL 5 MINUTE * row_number() OVER (ORDER BY t) AS run FROM ms)
SELECT symbol, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(max(t) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS gap_end, count(*) AS n_bars FROM r GROUP BY symbol, run ORDER BY n_bars DESC, min(t) LIMIT 20""")
def gap_runs_topk(spark, d):
    g = Q.gap_runs(bars(spark, d, 5), 5, Calendar())
    return g.select("symbol", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("gap_start", "gap_end")), "n_bars")


@query(f"WITH {EV}, {bars_sql(5)}, {GRID} SELECT 'ALL' AS symbol, (SELECT count(*) FROM ex) AS expected, (SELECT count(*) FROM ms) AS missing, round(1 - (SELECT count(*) FROM ms) / (SELECT count(*) FROM ex), 9) AS completeness")
def completeness(spark, d):
    c = Q.completeness(bars(spark, d, 5), 5, Calendar())
    return c.select("symbol", "expected", "missing", F.round("completeness", 9).alias("completeness"))


REASON = "CASE WHEN close IS NULL THEN 'null_price' WHEN nonpos THEN 'non_positive' WHEN bad THEN 'inconsistent' WHEN off THEN 'off_grid' END"


@query(f"WITH {DIRTY} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM vb GROUP BY 1")
def clean_reason_counts(spark, d):
    return dirty(spark, d).groupBy(F.coalesce(Q.reason(5), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def clean_sql(order: str) -> str:
    return f"WITH {DIRTY} " + final({x: x for x in ("open", "high", "low", "close", "volume")}, f"(SELECT * FROM vb WHERE {REASON} IS NULL QUALIFY row_number() OVER (PARTITION BY close_time ORDER BY row_no {order}) = 1)")


@query(clean_sql("DESC"))
def clean_keep_last(spark, d):
    return told(Q.clean(dirty(spark, d), 5), "open", "high", "low", "close", "volume")


@query(clean_sql("ASC"))
def clean_keep_first(spark, d):
    return told(Q.clean(dirty(spark, d), 5, Q.Cleaning(duplicates="keep_first")), "open", "high", "low", "close", "volume")


@query(f"WITH {DIRTY} SELECT row_no, round(CASE WHEN bad THEN greatest(high, open, close) ELSE high END, 5) + 0.0 AS high, round(CASE WHEN bad THEN least(low, open, close) ELSE low END, 5) + 0.0 AS low FROM vb")
def ohlc_clip(spark, d):
    return Q.clip_prices(dirty(spark, d)).select("row_no", *((F.round(c, 5) + 0.0).alias(c) for c in ("high", "low")))


@query(f"""WITH {EV}, {bars_sql(5)}, l AS (SELECT *, date_diff('minute', close_time, lead(close_time) OVER (ORDER BY close_time)) / 5 - 1 AS m FROM b),
f AS (SELECT symbol, close_time + INTERVAL 5 MINUTE * i AS close_time, close, 0.0 AS volume, 1 AS is_synthetic FROM l, generate_series(1, 3) g(i) WHERE m >= 1 AND m <= 3 AND i <= m UNION ALL SELECT symbol, close_time, close, volume, 0 FROM b)
""" + final({x: x for x in ("close", "volume", "is_synthetic")}, "f"))
def fill_small_gaps(spark, d):
    return told(Q.fill_gaps(bars(spark, d, 5), 5, 3), "close", "volume", "is_synthetic")


# --- as-of joins and levels -------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, {bars_sql()}, {bars_sql(60, 'h')}, hr AS (SELECT *, ln(close / lag(close) OVER (ORDER BY close_time)) AS close_ret FROM h WHERE close_time <= (SELECT max(close_time) FROM b))
SELECT b.symbol, strftime(b.close_time, '%Y-%m-%d %H:%M:%S') AS close_at, round(b.close, 5) + 0.0 AS close, round(hr.close_ret, 5) + 0.0 AS close_ret_1h FROM b ASOF LEFT JOIN hr ON b.close_time >= hr.close_time""")
def asof_inclusive_1h(spark, d):
    b = bars(spark, d)
    hour = resample(b, 15, 60).withColumn("close_ret", F.log(F.col("close") / R.lag("close")))
    return told(asof(b, hour, ["close_ret"], suffix="_1h"), "close", "close_ret_1h")


def level_sql(key: str) -> str:
    return f"""WITH {EV}, {bars_sql()}, {SESSION_SQL.format('b')}, k AS (SELECT *, {key} AS key FROM se), lv AS (SELECT key, max(high) AS hi, min(low) AS lo, max(close_time) AS t FROM k WHERE key IS NOT NULL GROUP BY key)
SELECT k.symbol, strftime(k.close_time, '%Y-%m-%d %H:%M:%S') AS close_at, round(hi, 5) + 0.0 AS x_high, round(lo, 5) + 0.0 AS x_low FROM k ASOF LEFT JOIN lv ON k.close_time > lv.t"""


TRADING_DAY = "CAST(" + LOCAL.format("close_time") + " AS DATE) + CAST(CASE WHEN hour(" + LOCAL.format("close_time") + ") >= 18 THEN 1 ELSE 0 END AS INTEGER)"


def levels(spark, d, key):
    b = classify(bars(spark, d)).withColumn("_day", Calendar().trading_day(F.col("close_time")))
    b = b.withColumns({"_week": F.date_trunc("week", "_day"), "_ny": F.when(F.col("in_ny"), F.col("session_id"))})
    return told(completed_levels(b, {"x": F.col(key)}), "x_high", "x_low")


@query(level_sql(TRADING_DAY))
def asof_strict_prev_day(spark, d):
    return levels(spark, d, "_day")


@query(level_sql(f"date_trunc('week', {TRADING_DAY})"))
def asof_prev_week(spark, d):
    return levels(spark, d, "_week")


@query(level_sql("CASE WHEN in_ny THEN session_id END"))
def asof_session_levels(spark, d):
    return levels(spark, d, "_ny")


# --- features ---------------------------------------------------------------------------------------------------------


def ready(spark, d):
    return classify(G.shared(bars(spark, d)))


R_, A_ = "rg", f"(atr + {E})"
PRICE = {f"{n}_ret": f"ln({n} / c1)" for n in ("open", "high", "low", "close")} | {
    "body_ret": "(close - open) / close", "range_ret": "rg / close", "upper_wick": f"(high - greatest(open, close)) / (rg + {E})", "lower_wick": f"(least(open, close) - low) / (rg + {E})",
    "body_to_range": f"abs(close - open) / (rg + {E})", "close_position": f"(close - low) / (rg + {E})", "high_low_range_atr": f"rg / {A_}", "gap_atr": f"(open - c1) / {A_}",
    "ret_1_atr": f"(ln(close) - ln({lagged('close')})) * close / {A_}", "ret_10_atr": f"(ln(close) - ln({lagged('close', 10)})) * close / {A_} / sqrt(10)",
    "zscore_close_20": f"(close - {over('avg', 'close', 20)}) / ({over('stddev_pop', 'close', 20)} + {E})", "dist_sma_20_atr": f"(close - {over('avg', 'close', 20)}) / {A_}",
}


@query(f"{WITH_ATR} " + final(PRICE, "a"))
def price_geometry(spark, d):
    return told(G.price(ready(spark, d)), *PRICE)


@query(f"{WITH_ATR} " + final({"atr": "atr"}, "a"))
def atr_14(spark, d):
    return told(ready(spark, d), "atr")


VOL1 = f"v1 AS (SELECT *, ln(close) - ln(c1) AS lr, ln(greatest(high / (low + {E}), 1e-9)) AS hl, ln(greatest(close / (open + {E}), 1e-9)) AS co FROM a), v2 AS (SELECT *, {over('stddev_pop', 'lr', 20)} * sqrt(288) AS rv20, hl * hl AS hl2, 0.5 * hl * hl - (2 * ln(2) - 1) * co * co AS gk, 4 * {over('stddev_pop', 'close', 20)} / ({over('avg', 'close', 20)} + {E}) AS bb FROM v1)"
VOLATILITY = {
    "atr_pct": f"atr / (close + {E})", "realized_vol_20": "rv20", "parkinson_vol_20": f"sqrt({over('avg', 'hl2', 20)} / (4 * ln(2)))", "garman_klass_vol_20": f"sqrt(greatest({over('avg', 'gk', 20)}, 0))",
    "vol_of_vol_50": over("stddev_pop", "rv20", 50), "range_expansion": f"rg / ({over('avg', 'rg', 20)} + {E})", "range_compression": f"{over('avg', 'rg', 5)} / ({over('avg', 'rg', 50)} + {E})",
    "nr7": f"CAST(coalesce(rg <= {over('min', 'rg', 7)}, false) AS INTEGER)", "wr7": f"CAST(coalesce(rg >= {over('max', 'rg', 7)}, false) AS INTEGER)", "bb_width_20": "bb",
}


@query(f"{WITH_ATR}, {VOL1} " + final(VOLATILITY, "v2", 4))
def volatility_measures(spark, d):
    return told(G.volatility(ready(spark, d)), *VOLATILITY, digits=4)


@query(f"""{WITH_ATR}, l AS (SELECT *, list(atr) OVER {WIN.format(251)} AS xs FROM a),
p AS (SELECT *, list_filter(xs, lambda v: v IS NOT NULL) AS ys FROM l)
""" + final({"atr_percentile_252": "CASE WHEN atr IS NOT NULL AND len(ys) >= 25 THEN (len(list_filter(ys, lambda v: v < atr)) + (len(list_filter(ys, lambda v: v = atr)) + 1) / 2) / len(ys) END"}, "p", 3))
def rank_percentile(spark, d):
    return told(ready(spark, d).withColumn("atr_percentile_252", R.rank_pct("atr", 252)), "atr_percentile_252", digits=3)


def ema_sql(name: str, x: str, n: int, source: str = "s") -> str:
    """A recursive EMA of a column without nulls."""
    k = 2 / (n + 1)
    return f"{name} AS (SELECT rn, {x} AS y FROM {source} WHERE rn = 0 UNION ALL SELECT q.rn, y * {1 - k!r} + q.{x} * {k!r} FROM {name} JOIN {source} q ON q.rn = {name}.rn + 1)"


def wilder_sql(name: str, x: str, n: int, source: str = "s", first: int = 0) -> str:
    return f"{name} AS (SELECT rn, {x} AS y FROM {source} WHERE rn = {first} UNION ALL SELECT q.rn, y * {1 - 1 / n!r} + q.{x} * {1 / n!r} FROM {name} JOIN {source} q ON q.rn = {name}.rn + 1)"


@query(f"{WITH_ATR}, {ema_sql('e2', 'close', 20)}, {ema_sql('e5', 'close', 50)}, j AS (SELECT a.*, CASE WHEN a.rn >= 19 THEN e2.y END AS e20, CASE WHEN a.rn >= 49 THEN e5.y END AS e50 FROM a JOIN e2 USING (rn) JOIN e5 USING (rn)) " + final({"dist_ema_20_atr": f"(close - e20) / {A_}", "ema_slope_20": f"(e20 - {lagged('e20', 5)}) / (5 * atr + {E})", "dist_ema_50_atr": f"(close - e50) / {A_}", "ema_20_50_spread_atr": f"(e20 - e50) / {A_}", "ema_stack_score": "CASE WHEN e50 IS NOT NULL THEN CASE WHEN e20 > e50 THEN 1 ELSE -1 END END"}, "j", 4))
def ema_distances(spark, d):
    return told(G.trend(ready(spark, d), (20, 50)), "dist_ema_20_atr", "ema_slope_20", "dist_ema_50_atr", "ema_20_50_spread_atr", "ema_stack_score", digits=4)


@query(f"""{BASE}, x AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM s), {wilder_sql('wg', 'g', 14, 'x', 1)}, {wilder_sql('wl', 'l', 14, 'x', 1)},
j AS (SELECT s.*, CASE WHEN s.rn >= 14 THEN 100 - 100 / (1 + wg.y / (wl.y + {E})) END AS rsi FROM s LEFT JOIN wg USING (rn) LEFT JOIN wl USING (rn)) """ + final({"rsi_14": "rsi", "rsi_slope_5": f"rsi - {lagged('rsi', 5)}"}, "j", 4))
def rsi_14(spark, d):
    return told(G.trend(ready(spark, d)), "rsi_14", "rsi_slope_5", digits=4)


@query(f"""{WITH_ATR}, {ema_sql('f', 'close', 12)}, {ema_sql('g', 'close', 26)}, m AS (SELECT a.*, f.y - g.y AS macd FROM a JOIN f USING (rn) JOIN g USING (rn)),
sg AS (SELECT rn, macd AS y FROM m WHERE rn = 25 UNION ALL SELECT m.rn, y * 0.8 + m.macd * 0.2 FROM sg JOIN m ON m.rn = sg.rn + 1)
""" + final({"macd_hist_atr": f"CASE WHEN rn >= 33 THEN (macd - y) / {A_} END"}, "m LEFT JOIN sg USING (rn)", 4))
def macd_hist(spark, d):
    return told(G.trend(ready(spark, d)), "macd_hist_atr", digits=4)


@query(f"""{BASE}, u AS (SELECT *, high - lag(high) OVER (ORDER BY rn) AS up, lag(low) OVER (ORDER BY rn) - low AS dn FROM s),
x AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mm FROM u), {wilder_sql('wp', 'pm', 14, 'x')}, {wilder_sql('wm', 'mm', 14, 'x')}, {wilder_sql('wt', 'tr', 14, 'x')},
i AS (SELECT s.*, 100 * wp.y / (wt.y + {E}) AS dp, 100 * wm.y / (wt.y + {E}) AS dm FROM s JOIN wp USING (rn) JOIN wm USING (rn) JOIN wt USING (rn)), dx AS (SELECT *, 100 * abs(dp - dm) / (dp + dm + {E}) AS x FROM i), {wilder_sql('wx', 'x', 14, 'dx', 13)}
""" + final({"di_plus_14": "CASE WHEN rn >= 13 THEN dp END", "di_minus_14": "CASE WHEN rn >= 13 THEN dm END", "adx_14": "CASE WHEN rn >= 26 THEN y END"}, "i LEFT JOIN wx USING (rn)", 4))
def adx_di_14(spark, d):
    return told(G.trend(ready(spark, d)), "di_plus_14", "di_minus_14", "adx_14", digits=4)


OSC = f"""o1 AS (SELECT *, 100 * (close - {over('min', 'low', 14)}) / ({over('max', 'high', 14)} - {over('min', 'low', 14)} + {E}) AS k, (high + low + close) / 3 AS tp, abs(d) AS ad, ln(close) - ln({lagged('close', 8)}) AS l8, ln(close) - ln(c1) AS l1 FROM a),
o2 AS (SELECT *, abs(tp - {over('avg', 'tp', 20)}) AS dev FROM o1)"""
VR = f"{over('var_pop', 'l8', 100)} / (8 * {over('var_pop', 'l1', 100)} + {E})"
OSCILLATORS = {
    "stoch_k_14": "k", "stoch_d_3": over("avg", "k", 3), "williams_r_14": f"(100 - 100 * ({over('max', 'high', 14)} - close) / ({over('max', 'high', 14)} - {over('min', 'low', 14)} + {E})) / 100",
    "cci_20_norm": f"(tp - {over('avg', 'tp', 20)}) / (0.015 * {over('avg', 'dev', 20)} + {E}) / 100", "efficiency_ratio_20": f"abs(close - {lagged('close', 20)}) / ({over('sum', 'ad', 20)} + {E})",
    "linreg_slope_20_atr": f"(CASE WHEN count(close) OVER {WIN.format(19)} = 20 THEN regr_slope(close, rn) OVER {WIN.format(19)} END) / {A_}", "linreg_r2_20": f"CASE WHEN count(close) OVER {WIN.format(19)} = 20 THEN regr_r2(close, rn) OVER {WIN.format(19)} END",
    "hurst_vr_100": f"CASE WHEN {VR} IS NOT NULL THEN 0.5 + ln(greatest({VR}, 1e-6)) / (2 * ln(8)) END",
}


@query(f"{WITH_ATR}, {OSC} " + final(OSCILLATORS, "o2", 4))
def oscillators(spark, d):
    return told(G.trend(ready(spark, d)), *OSCILLATORS, digits=4)


VOLUME1 = f"""{SESSION_SQL.format('a')}, w1 AS (SELECT *, coalesce(volume, 0) AS v, hour(close_time) * 60 + minute(close_time) AS mod, ((close - low) - (high - close)) / (rg + {E}) AS bp, (high + low + close) / 3 AS tp FROM se),
w2 AS (SELECT *, bp * v AS bpv, sign(d) * v AS sv, {over('avg', 'v', 20)} AS m20, sum(tp * v) OVER (PARTITION BY session_id ORDER BY close_time ROWS UNBOUNDED PRECEDING) AS pv, sum(v) OVER (PARTITION BY session_id ORDER BY close_time ROWS UNBOUNDED PRECEDING) AS sv0,
  CASE WHEN count(v) OVER t >= 5 THEN quantile_cont(v, 0.5) OVER t END AS usual FROM w1 WINDOW t AS (PARTITION BY mod ORDER BY close_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT *, {over('sum', 'bpv', 20)} AS f20 FROM w2)"""
VOLUME = {
    "volume_ratio": f"v / (m20 + {E})", "relative_volume_tod": f"v / (usual + {E})", "volume_zscore_50": f"(v - {over('avg', 'v', 50)}) / ({over('stddev_pop', 'v', 50)} + {E})", "volume_expansion": f"{over('avg', 'v', 5)} / ({over('avg', 'v', 50)} + {E})",
    "buy_pressure": "bp", "cvd_proxy_20": f"(f20 - {over('avg', 'f20', 50)}) / ({over('stddev_pop', 'f20', 50)} + {E})", "obv_slope_20": f"CASE WHEN rn >= 20 THEN sum(sv) OVER {WIN.format(19)} / ({over('sum', 'v', 20)} + {E}) END",
    "dist_vwap_atr": f"(close - CASE WHEN sv0 > 0 THEN pv / (sv0 + {E}) ELSE tp END) / {A_}",
}


@query(f"{WITH_ATR}, {VOLUME1} " + final(VOLUME, "w3", 4))
def volume_measures(spark, d):
    return told(G.volume(ready(spark, d)), *VOLUME, digits=4)


# --- one long series in many tasks ------------------------------------------------------------------------------------

CHUNK = 600


def chunked(spark, d, group, step, **p):
    """A group of one symbol's bars in chunks: no window of it, nor of the numbers and ATR before it, spans the series."""
    ready = G.shared(bars(spark, d), CHUNK)
    return in_chunks(ready, step, G.reach(group, **p), CHUNK)


@query(f"{WITH_ATR} " + final(PRICE, "a"))
def price_geometry_in_chunks(spark, d):
    p = {"returns": (1, 10), "zscores": (20,)}
    return told(chunked(spark, d, "price", lambda b: G.price(b, **p), **p), *PRICE)


@query(f"{WITH_ATR}, {VOL1} " + final(VOLATILITY, "v2", 4))
def volatility_in_chunks(spark, d):
    p = {"atrs": (14, 20), "percentiles": (100,), "bb_rank": 100}
    return told(chunked(spark, d, "volatility", lambda b: G.volatility(b, **p), **p), *VOLATILITY, digits=4)


@query(f"{WITH_ATR}, {OSC} " + final(OSCILLATORS, "o2", 4))
def oscillators_in_chunks(spark, d):
    p = {"emas": (20, 50), "regressions": (20,), "hurst": 100}
    return told(chunked(spark, d, "trend", lambda b: G.trend(b, **p), **p), *OSCILLATORS, digits=4)


SW = f"p1 AS (SELECT *, CASE WHEN {lagged('high', 2)} >= {over('max', 'high', 5)} THEN {lagged('high', 2)} END AS ph, CASE WHEN {lagged('low', 2)} <= {over('min', 'low', 5)} THEN {lagged('low', 2)} END AS pl FROM a)"
SW2 = f"""{SW}, p2 AS (SELECT *, last_value(ph IGNORE NULLS) OVER x AS lh, last_value(pl IGNORE NULLS) OVER x AS ll, last_value(CASE WHEN ph IS NOT NULL THEN rn - 2 END IGNORE NULLS) OVER x AS hrn, last_value(CASE WHEN pl IS NOT NULL THEN rn - 2 END IGNORE NULLS) OVER x AS lrn, last_value(ph IGNORE NULLS) OVER y AS oh, last_value(pl IGNORE NULLS) OVER y AS ol FROM p1
  WINDOW x AS (ORDER BY close_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (ORDER BY close_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p3 AS (SELECT *, CASE WHEN close > lh THEN 1 WHEN close < ll THEN -1 END AS br, CASE WHEN ph IS NOT NULL AND oh IS NOT NULL THEN CASE WHEN ph > oh THEN 1 ELSE 0 END END AS fhh, CASE WHEN pl IS NOT NULL AND ol IS NOT NULL THEN CASE WHEN pl > ol THEN 1 ELSE 0 END END AS fhl FROM p2),
p4 AS (SELECT *, coalesce(last_value(br IGNORE NULLS) OVER (ORDER BY close_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM p3)"""
STRUCTURE = {
    "swing_high_flag": "CAST(ph IS NOT NULL AS INTEGER)", "swing_low_flag": "CAST(pl IS NOT NULL AS INTEGER)", "last_swing_high_dist_atr": f"(close - lh) / {A_}", "last_swing_high_age": "rn - hrn", "last_swing_low_dist_atr": f"(close - ll) / {A_}", "last_swing_low_age": "rn - lrn",
    "hh": "coalesce(last_value(fhh IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING), 0)", "hl": "coalesce(last_value(fhl IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING), 0)",
    "lh": "coalesce(last_value(1 - fhh IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING), 0)", "ll": "coalesce(last_value(1 - fhl IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING), 0)",
    "bos_age": "rn - last_value(CASE WHEN br IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING)", "bos_strength": f"tanh(greatest(last_value(CASE WHEN br = 1 THEN close - lh WHEN br = -1 THEN ll - close END IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING) / {A_}, 0) / (1 + {E}))",
    "bos_bull": "CAST(coalesce(close > lh, false) AS INTEGER)", "bos_bear": "CAST(coalesce(close < ll, false) AS INTEGER)", "mss_bull": "CAST(coalesce(br = 1 AND pb <= 0, false) AS INTEGER)", "mss_bear": "CAST(coalesce(br = -1 AND pb >= 0, false) AS INTEGER)",
    "range_width_atr": f"({over('max', 'high', 50)} - {over('min', 'low', 50)}) / {A_}", "range_position": f"(close - {over('min', 'low', 50)}) / ({over('max', 'high', 50)} - {over('min', 'low', 50)} + {E})",
}


@query(f"{WITH_ATR}, {SW2} " + final(STRUCTURE, "p4", 4))
def structure_events(spark, d):
    return told(G.structure(ready(spark, d)), *STRUCTURE, digits=4)


@query(f"{WITH_ATR}, {SW2} " + final(STRUCTURE, "p4", 4))
def structure_events_in_chunks(spark, d):
    return told(G.structure(G.shared(bars(spark, d), CHUNK), chunk_rows=CHUNK), *STRUCTURE, digits=4)


STRENGTH = f"""{SW2}, e0 AS (SELECT rn, 0 AS side, CASE WHEN fhh = 1 THEN 1 ELSE -1 END AS v FROM p4 WHERE fhh IS NOT NULL UNION ALL SELECT rn, 1, CASE WHEN fhl = 1 THEN 1 ELSE -1 END FROM p4 WHERE fhl IS NOT NULL),
e1 AS (SELECT rn, side, sum(v) OVER (ORDER BY rn, side ROWS 5 PRECEDING) AS t, count(v) OVER (ORDER BY rn, side ROWS 5 PRECEDING) AS k FROM e0), e2 AS (SELECT rn, arg_max(abs(t) / k, side) AS st FROM e1 GROUP BY rn)"""


@query(f"{WITH_ATR}, {STRENGTH} " + final({"structure_strength": "last_value(st IGNORE NULLS) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING)"}, "p4 LEFT JOIN e2 USING (rn)", 4))
def structure_strength(spark, d):
    return told(G.structure(ready(spark, d)), "structure_strength", digits=4)


@query(f"""{WITH_ATR}, q AS (SELECT *, {over('max', 'high', 50)} AS hi, {over('min', 'low', 50)} AS lo FROM a), r AS (SELECT *, CASE WHEN hi IS NOT NULL THEN CAST(coalesce(high >= hi - 0.1 * atr, false) AS INTEGER) END AS eh, CASE WHEN lo IS NOT NULL THEN CAST(coalesce(low <= lo + 0.1 * atr, false) AS INTEGER) END AS el FROM q)
""" + final({"equal_highs_count_50": over("sum", "eh", 50), "equal_lows_count_50": over("sum", "el", 50)}, "r"))
def equal_levels(spark, d):
    return told(G.liquidity(ready(spark, d), Calendar().trading_day), "equal_highs_count_50", "equal_lows_count_50")


LV = f"""{SESSION_SQL.format('a')}, k0 AS (SELECT *, {TRADING_DAY} AS day, date_trunc('week', {TRADING_DAY}) AS wk, max(high) OVER z AS session_high, min(low) OVER z AS session_low FROM se WINDOW z AS (PARTITION BY session_id ORDER BY close_time ROWS UNBOUNDED PRECEDING)),
""" + ",\n".join(f"l{i} AS (SELECT {key} AS key, max(high) AS {n}_high, min(low) AS {n}_low, max(close_time) AS t FROM k0 WHERE {cond} GROUP BY 1), k{i} AS (SELECT k{i - 1}.*, {n}_high, {n}_low FROM k{i - 1} ASOF LEFT JOIN l{i} ON k{i - 1}.close_time > l{i}.t)" for i, (n, key, cond) in enumerate((("prev_day", "day", "true"), ("prev_week", "wk", "true"), ("asia", "session_id", "in_asia"), ("london", "session_id", "in_london"), ("ny", "session_id", "in_ny")), 1))
OFFS = "list_filter([" + ", ".join(f"({x} - close) / {A_}" for x in G.LEVELS) + "], lambda x: x IS NOT NULL)"
LAGS = "[" + ", ".join(lagged(x) for x in G.LEVELS[:10]) + "]"
LVS = f"{LV}, kk AS (SELECT *, {OFFS} AS offs, {LAGS} AS lags FROM k5), kl AS (SELECT *, list_filter(lags, lambda x: high > x + 0.1 * atr AND close < x) AS ov, list_filter(lags, lambda x: low < x - 0.1 * atr AND close > x) AS un FROM kk), km AS (SELECT *, coalesce(len(ov), 0) > 0 AS sh, coalesce(len(un), 0) > 0 AS sl FROM kl)"
DEPTH = f"(tanh(greatest(CASE WHEN sh THEN (high - list_min(ov)) / {A_} END, CASE WHEN sl THEN (list_max(un) - low) / {A_} END)))"
LEVEL_COLS = {f"dist_{x}_atr": f"(close - {x}) / {A_}" for x in G.LEVELS} | {
    "nearest_level_above_atr": "list_min(list_filter(offs, lambda x: x > 0))", "nearest_level_below_atr": "list_min([-x for x in offs if x < 0])", "level_cluster_density": "CASE WHEN len(offs) > 0 THEN len(list_filter(offs, lambda x: abs(x) <= 0.5)) / len(offs) END",
    "sweep_high": "CAST(sh AS INTEGER)", "sweep_low": "CAST(sl AS INTEGER)", "sweep_strength": f"CASE WHEN sh THEN {DEPTH} * (high - close) / (rg + {E}) WHEN sl THEN {DEPTH} * (close - low) / (rg + {E}) ELSE 0 END",
}


@query(f"{WITH_ATR}, {LVS} " + final(LEVEL_COLS, "km", 4))
def level_distances(spark, d):
    return told(G.liquidity(ready(spark, d), Calendar().trading_day), *LEVEL_COLS, digits=4)


LAST = "OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING)"
AFTER = f"""kn AS (SELECT *, {LEVEL_COLS['sweep_strength']} AS strength, CASE WHEN sh OR sl THEN rn END AS er, CASE WHEN sh THEN 1.0 WHEN sl THEN -1.0 END AS ed FROM km),
ko AS (SELECT *, rn - last_value(er IGNORE NULLS) {LAST} AS age, last_value(ed IGNORE NULLS) {LAST} AS dir, last_value(CASE WHEN er IS NOT NULL THEN close END IGNORE NULLS) {LAST} AS sc, last_value(CASE WHEN er IS NOT NULL THEN strength END IGNORE NULLS) {LAST} AS ss FROM kn),
kp AS (SELECT *, coalesce(age <= 12, false) AS live, tanh(greatest(-dir * (close - sc) / {A_}, 0)) AS follow FROM ko)"""


@query(f"{WITH_ATR}, {LVS}, {AFTER} " + final({"sweep_age": "age", "sweep_direction": "CASE WHEN live THEN dir ELSE 0 END", "stop_hunt_score": "CASE WHEN live THEN ss * follow ELSE 0 END", "rejection_after_sweep": "CASE WHEN live THEN follow ELSE 0 END"}, "kp", 4))
def sweep_aftermath(spark, d):
    return told(G.liquidity(ready(spark, d), Calendar().trading_day), "sweep_age", "sweep_direction", "stop_hunt_score", "rejection_after_sweep", digits=4)


TIME = {f"{n}_{f}": f"{f}(2 * pi() * {x})" for n, x in (("hour", "hour(close_time) / 24"), ("minute_of_day", "(hour(close_time) * 60 + minute(close_time)) / 1440"), ("dow", "(isodow(close_time) - 1) / 7"), ("month", "month(close_time) / 12")) for f in ("sin", "cos")} | {
    "day_of_week": "isodow(close_time) - 1", "is_month_end": "CAST(day(close_time) >= 28 AS INTEGER)", "bars_since_session_open": "row_number() OVER (PARTITION BY session_id ORDER BY close_time) - 1",
    "bars_since_gap": "row_number() OVER (PARTITION BY isl ORDER BY close_time) - 1", "session_range_atr": f"(max(high) OVER (PARTITION BY session_id ORDER BY close_time ROWS UNBOUNDED PRECEDING) - min(low) OVER (PARTITION BY session_id ORDER BY close_time ROWS UNBOUNDED PRECEDING)) / {A_}",
    "session_trend": f"tanh((close - first_value(open) OVER (PARTITION BY session_id ORDER BY close_time)) / {A_} / 3)",
}


@query(f"{WITH_ATR}, {SESSION_SQL.format('a')}, gp AS (SELECT *, coalesce(date_diff('minute', lag(close_time) OVER (ORDER BY close_time), close_time) > 15, true) AS gap FROM se), il AS (SELECT *, sum(CAST(gap AS INTEGER)) OVER (ORDER BY close_time ROWS UNBOUNDED PRECEDING) AS isl FROM gp) " + final(TIME, "il"))
def session_clock(spark, d):
    return told(G.clock(ready(spark, d), 15), *TIME)


OLD = "(PARTITION BY session ORDER BY close_time ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
TYPICAL = "CASE " + " ".join(f"WHEN labels = {n} AND count(atr) OVER {OLD.format(1920 // n)} >= {max(10, 1920 // n // 10)} THEN avg(atr) OVER {OLD.format(1920 // n)}" for n in range(1, 6)) + " END"
STATS = f"""z1 AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS size, row_number() OVER (PARTITION BY session_id ORDER BY close_time) - 1 AS pos, (SELECT count(DISTINCT session) FROM se) AS labels FROM se),
z2 AS (SELECT *, least(1, greatest(0, pos / ((SELECT quantile_cont(size, 0.5) FROM z1 WHERE size > 1) + {E}))) AS progress, {TYPICAL} AS typical FROM z1)"""


@query(f"{WITH_ATR}, {SESSION_SQL.format('a')}, {STATS} " + final({"session_progress": "progress", "session_atr_ratio": f"atr / (typical + {E})", "is_session_last_hour": "CAST(progress > 0.85 AS INTEGER)", "is_session_first_hour": "CAST(pos < 4 AS INTEGER)"} | {f"session_is_{n.lower()}": f"CAST(session = '{n}' AS INTEGER)" for n in ("ASIA", "LONDON", "NY", "LONDON_NY_OVERLAP", "OFF")}, "z2", 4))
def session_statistics(spark, d):
    return told(G.clock(ready(spark, d), 15), "session_progress", "session_atr_ratio", "is_session_last_hour", "is_session_first_hour", *(f"session_is_{n}" for n in ("asia", "london", "ny", "london_ny_overlap", "off")), digits=4)


def sq(x: str, k: float = 1.0) -> str:
    return f"tanh(greatest({x}, 0) / ({k} + {E}))"


PT = f"""t1 AS (SELECT *, {lagged('bd')} AS b1, {lagged('open')} AS o1, {over('avg', 'rg', 20)} AS r20, CASE WHEN count(high) OVER z = 20 THEN max(high) OVER z END AS qh, CASE WHEN count(high) OVER z = 20 THEN min(low) OVER z END AS ql, CAST(bd > 0 AS INTEGER) AS up, greatest(bd, 0) AS ub FROM a
  WINDOW z AS (PARTITION BY symbol ORDER BY close_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
PUSH = f"(0.5 + 0.5 * {sq(f'rg / (r20 + {E}) - 1')})"
ENG = f"{sq(f'abs(bd) / (abs(b1) + {E}) - 1')} * {sq(f'abs(bd) / {A_}')}"
PATTERN = {
    "engulf_bull_strength": f"CASE WHEN bd > 0 AND b1 < 0 AND close > o1 AND open < c1 THEN {ENG} END", "engulf_bear_strength": f"CASE WHEN bd < 0 AND b1 > 0 AND close < o1 AND open > c1 THEN {ENG} END",
    "pinbar_bull_strength": f"(least(open, close) - low) / (rg + {E}) * (1 - least(abs(bd) / (rg + {E}), 1)) * {sq(f'rg / {A_}')}", "rejection_bear_strength": f"(high - greatest(open, close)) / (rg + {E}) * (1 - (close - low) / (rg + {E})) * {sq(f'rg / {A_}', 1.5)}",
    "breakout_bull_strength": f"CASE WHEN close > qh THEN {sq(f'(close - qh) / {A_}', 0.5)} * {PUSH} END", "breakout_bear_strength": f"CASE WHEN close < ql THEN {sq(f'(ql - close) / {A_}', 0.5)} * {PUSH} END",
    "momentum_bull_strength": f"{sq(f'{over('sum', 'ub', 5)} / (5 * atr + {E})', 0.3)} * {over('avg', 'up', 5)}",
}


@query(f"{WITH_ATR}, {PT} " + final({k: f"CASE WHEN atr IS NULL THEN 0 ELSE coalesce(least(1, greatest(0, {v})), 0) END" for k, v in PATTERN.items()}, "t1", 4))
def candle_patterns(spark, d):
    return told(G.patterns(ready(spark, d)), *PATTERN, digits=4)


BEFORE = "(PARTITION BY symbol ORDER BY close_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
RETEST = f"""{PT}, t2 AS (SELECT *, (ql - low) / {A_} AS penl, (high - qh) / {A_} AS penh, list(rg) OVER {WIN.format(6)} AS seven FROM t1)"""
BEST = "(len(list_filter(seven, lambda v: v < rg)) + (len(list_filter(seven, lambda v: v = rg)) + 1) / 2) / 7"
RETESTS = {
    "double_retest_bull_strength": f"CASE WHEN atr IS NOT NULL AND abs(low - ql) / {A_} < 0.5 THEN {sq(f'max(penl) OVER {BEFORE} - penl', 0.5)} END", "double_retest_bear_strength": f"CASE WHEN atr IS NOT NULL AND abs(high - qh) / {A_} < 0.5 THEN {sq(f'max(penh) OVER {BEFORE} - penh', 0.5)} END",
    "compression_strength": f"CASE WHEN len(seven) = 7 THEN 1 - {BEST} END", "pinbar_bear_strength": f"CASE WHEN atr IS NOT NULL THEN (high - greatest(open, close)) / (rg + {E}) * (1 - least(abs(bd) / (rg + {E}), 1)) * {sq(f'rg / {A_}')} END",
    "rejection_bull_strength": f"CASE WHEN atr IS NOT NULL THEN (least(open, close) - low) / (rg + {E}) * (close - low) / (rg + {E}) * {sq(f'rg / {A_}', 1.5)} END",
    "momentum_bear_strength": f"CASE WHEN atr IS NOT NULL THEN {sq(f'sum(greatest(-bd, 0)) OVER {WIN.format(4)} / (5 * atr + {E})', 0.3)} * (1 - avg(up) OVER {WIN.format(4)}) END",
}


@query(f"{WITH_ATR}, {RETEST} " + final({k: f"coalesce(least(1, greatest(0, {v})), 0)" for k, v in RETESTS.items()}, "t2", 4))
def double_retest(spark, d):
    return told(G.patterns(ready(spark, d)), *RETESTS, digits=4)


RANK1000 = "CASE WHEN atr IS NOT NULL AND len(ys) >= 100 THEN (len(list_filter(ys, lambda v: v < atr)) + (len(list_filter(ys, lambda v: v = atr)) + 1) / 2) / len(ys) END"
REGIME = f"""{VOL1}, {wilder_sql('w2', 'tr', 20)}, {wilder_sql('w5', 'tr', 50)}, {ema_sql('e2', 'close', 20)},
r1 AS (SELECT v2.*, CASE WHEN v2.rn >= 19 THEN w2.y END AS atr20, CASE WHEN v2.rn >= 49 THEN w5.y END AS atr50, CASE WHEN v2.rn >= 19 THEN e2.y END AS e20, list(atr) OVER {WIN.format(999)} AS xs FROM v2 JOIN w2 USING (rn) JOIN w5 USING (rn) JOIN e2 USING (rn)),
r2 AS (SELECT *, list_filter(xs, lambda v: v IS NOT NULL) AS ys FROM r1), r3 AS (SELECT *, {RANK1000} AS p FROM r2), r4 AS (SELECT *, CASE WHEN p < 0.2 THEN 0 WHEN p < 0.8 THEN 1 WHEN p < 0.95 THEN 2 WHEN p IS NOT NULL THEN 3 END AS regime FROM r3)"""
REGIMES = {"atr_50": "atr50", "atr_ratio_fast_slow": f"atr / (atr50 + {E})", "atr_percentile_1000": "p", "squeeze_flag": f"CAST(coalesce(bb < 3 * atr20 / (e20 + {E}), false) AS INTEGER)", "vol_regime": "regime"}
REGIMES |= {f"vol_regime_is_{n}": f"CAST(coalesce(regime = {k}, false) AS INTEGER)" for k, n in enumerate(("low", "normal", "high", "extreme"))}


@query(f"{WITH_ATR}, {REGIME} " + final(REGIMES, "r4", 3))
def volatility_regimes(spark, d):
    return told(G.volatility(ready(spark, d)), *REGIMES, digits=3)


@query(f"""{BASE}, x AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM s), {wilder_sql('wg', 'g', 14, 'x', 1)}, {wilder_sql('wl', 'l', 14, 'x', 1)},
j AS (SELECT s.*, CASE WHEN s.rn >= 14 THEN 100 - 100 / (1 + wg.y / (wl.y + {E})) END AS rsi FROM s LEFT JOIN wg USING (rn) LEFT JOIN wl USING (rn)),
k AS (SELECT *, {over('min', 'close', 20)} AS lc, {over('max', 'close', 20)} AS hc, {over('min', 'rsi', 20)} AS lr, {over('max', 'rsi', 20)} AS hr FROM j) """ + final({"rsi_divergence_20": "CASE WHEN lc IS NOT NULL THEN CAST(close <= lc AND NOT coalesce(rsi <= lr, false) AS INTEGER) - CAST(close >= hc AND NOT coalesce(rsi >= hr, false) AS INTEGER) END"}, "k", 4))
def rsi_divergence(spark, d):
    return told(G.trend(ready(spark, d)), "rsi_divergence_20", digits=4)


RN = f"""rr AS (SELECT *, time_bucket(INTERVAL 1 HOUR, open_time, TIMESTAMP '2000-01-01') AS cell FROM a), rs AS (SELECT *, max(high) OVER z AS ch, min(low) OVER z AS cl, first_value(open) OVER z AS co, row_number() OVER z AS cn FROM rr WINDOW z AS (PARTITION BY cell ORDER BY close_time ROWS UNBOUNDED PRECEDING))"""
RUNNING = {"running_progress_1h": "least(1, cn / 4)", "running_range_atr_1h": f"(ch - cl) / {A_}", "running_position_1h": f"(close - cl) / (ch - cl + {E})", "running_return_atr_1h": f"(close - co) / {A_}"}


@query(f"{WITH_ATR}, {RN} " + final(RUNNING, "rs"))
def running_htf(spark, d):
    return told(G.running(ready(spark, d), 15, (60,)), *RUNNING)


@query(f"WITH {EV}, {bars_sql()}, {bars_sql(60, 'h')}, f AS (SELECT symbol, close_time, close, ln(close / lag(close) OVER (ORDER BY close_time)) AS close_ret, {over('avg', 'close', 20)} AS sma_20, (close - {over('avg', 'close', 20)}) / ({over('stddev_pop', 'close', 20)} + {E}) AS zscore_close_20 FROM b), hr AS (SELECT *, ln(close / lag(close) OVER (ORDER BY close_time)) AS hret FROM h WHERE close_time <= (SELECT max(close_time) FROM b)) SELECT f.symbol, strftime(f.close_time, '%Y-%m-%d %H:%M:%S') AS close_at, round(f.close_ret, 5) + 0.0 AS close_ret, round(sma_20, 5) + 0.0 AS sma_20, round(zscore_close_20, 5) + 0.0 AS zscore_close_20, round(hret, 5) + 0.0 AS close_ret_1h FROM f ASOF LEFT JOIN hr ON f.close_time >= hr.close_time")
def first_slice(spark, d):
    """Events to bars, features, coarser bars, and their return joined as of each close."""
    b = bars(spark, d)
    out = b.withColumns({"close_ret": F.log(F.col("close") / R.lag("close")), "sma_20": R.mean("close", 20), "zscore_close_20": R.zscore("close", 20)})
    hour = resample(b, 15, 60).withColumn("close_ret", F.log(F.col("close") / R.lag("close")))
    return told(asof(out, hour, ["close_ret"], suffix="_1h"), "close_ret", "sma_20", "zscore_close_20", "close_ret_1h")


# --- zones, engine, stores: beyond SQL, tested against step-by-step code ----------------------------------------------


def zone_sql() -> str:
    """Zones by recursion over bars; a side is that of prices times 1 or -1. Lists hold the zones alive, the nearest first."""
    out, cols = [], {}
    for side, x in (("bull", 1), ("bear", -1)):
        high, low = ("high", "low") if x > 0 else ("low", "high")
        lag2 = ", ".join(f"lag({v}, {k}) OVER (ORDER BY rn) AS {v}{k}" for v in "ohlc" for k in (1, 2))
        near = lambda zones, n: f"list_transform(list_sort(list_transform({zones}, lambda v, j: {{'d': abs(c - v.top), 'j': j, 'v': v}}))[1:{n}], lambda v: v.v)"
        alive = lambda zones: f"list_filter(list_transform({zones}, lambda v: {{'bottom': v.bottom, 'top': v.top, 'born': v.born, 'deep': least(v.deep, l), 'move': v.move, 'gap': v.gap}}), lambda v: n.rn - v.born <= 288 AND v.deep > v.bottom)"
        out.append(f"""{side}_m AS (SELECT rn, atr, {x} * open AS o, {x} * {high} AS h, {x} * {low} AS l, {x} * close AS c FROM a),
{side}_z AS (SELECT *, {lag2} FROM {side}_m),
{side}_n AS (SELECT *, CASE WHEN atr > 0 AND l - h2 >= 0.15 * atr AND l > h2 THEN [{{'bottom': h2, 'top': l, 'born': rn, 'deep': l, 'move': 0.0::DOUBLE, 'gap': 1.0::DOUBLE}}] ELSE [] END AS new_gap,
  CASE WHEN atr > 0 AND h2 IS NOT NULL AND (c - c1) / atr >= 1 AND (c1 < o1 OR c2 < o2) THEN [{{'bottom': CASE WHEN c1 < o1 THEN l1 ELSE l2 END, 'top': CASE WHEN c1 < o1 THEN h1 ELSE h2 END, 'born': rn, 'deep': 'inf'::DOUBLE, 'move': (c - c1) / atr, 'gap': CASE WHEN l > h2 THEN 1.0 ELSE 0.0 END::DOUBLE}}] ELSE [] END AS new_block FROM {side}_z),
{side}_r AS (SELECT rn, new_gap[1:0] AS gaps, new_block[1:0] AS blocks FROM {side}_n WHERE rn = 0 UNION ALL
  SELECT n.rn, CASE WHEN atr > 0 THEN {near(alive('list_concat(gaps, new_gap)'), 3)} ELSE gaps END, CASE WHEN atr > 0 THEN {near(alive('list_concat(blocks, new_block)'), 2)} ELSE blocks END FROM {side}_r r JOIN {side}_n n ON n.rn = r.rn + 1),
{side}_s AS (SELECT rn, c, atr, len(gaps) AS n_gaps, gaps[1] AS g, blocks[1] AS b, least(1, greatest(0, (gaps[1].top - gaps[1].deep) / (gaps[1].top - gaps[1].bottom + {E}))) AS fill,
  least(1, greatest(0, (blocks[1].top - blocks[1].deep) / (blocks[1].top - blocks[1].bottom + {E}))) AS used FROM {side}_r JOIN {side}_n USING (rn))""")
        s, known = f"{side}_s", "a.atr > 0"
        own = lambda v, has: f"CASE WHEN {known} AND {has} IS NOT NULL THEN {v} ELSE 0 END"
        size, move = f"({s}.g.top - {s}.g.bottom) / a.atr", f"{s}.b.move"
        gap = {"exists": "1", "size_atr": size, "dist_atr": f"({s}.c - {s}.g.top) / a.atr", "age": f"a.rn - {s}.g.born", "fill_pct": f"{s}.fill", "strength": f"tanh(greatest({size}, 0) / (1 + {E})) * (1 - least(1, greatest(0, (a.rn - {s}.g.born) / 288))) * (1 - {s}.fill)"}
        block = {"exists": "1", "dist_atr": f"({s}.c - {s}.b.top) / a.atr", "size_atr": f"({s}.b.top - {s}.b.bottom) / a.atr", "age": f"a.rn - {s}.b.born", "mitigation_pct": f"{s}.used", "mitigated": f"CASE WHEN {s}.used > 0 THEN 1 ELSE 0 END", "strength": f"tanh(greatest({move}, 0) / (2 + {E})) * (1 - least(1, greatest(0, (a.rn - {s}.b.born) / 288))) * (1 - {s}.used)"}
        cols |= {f"fvg_{side}_{k}": own(v, f"{s}.g") for k, v in gap.items()} | {f"ob_{side}_{k}": own(v, f"{s}.b") for k, v in block.items()}
        cols[f"fvg_count_{side}"] = f"CASE WHEN {known} THEN {s}.n_gaps ELSE 0 END"
    n, m = cols["fvg_count_bull"], cols["fvg_count_bear"]
    cols["fvg_imbalance"] = f"({n} - {m}) / ({n} + {m} + {E})"
    cols["ob_confluence_fvg"] = f"CASE WHEN {known} THEN greatest(coalesce(bull_s.b.gap, 0), coalesce(bear_s.b.gap, 0)) ELSE 0 END"
    return f"{WITH_ATR}, {', '.join(out)} " + final(cols, "a JOIN bull_s USING (rn) JOIN bear_s USING (rn)")


ZONE_SQL = zone_sql()


def zone_names() -> list[str]:
    from barlake.plans.manifest import fvg, order_blocks

    return [n for n, _ in [*fvg(), *order_blocks()]]


@query(ZONE_SQL)
def zone_states(spark, d):
    from barlake.operators.zones import zones

    return told(zones(ready(spark, d)), *zone_names())


@query(ZONE_SQL)
def zone_states_in_chunks(spark, d):
    from barlake.operators.zones import zones

    return told(zones(G.shared(bars(spark, d), CHUNK), CHUNK), *zone_names())


# --- streams: features of new bars from state that history has primed --------------------------------------------------

LIVE_FROM = "2024-01-11 00:00:00"


def live(spark, d):
    """Features of the bars after LIVE_FROM, which come in three files and micro-batches; those before prime the state."""
    from barlake.sources.scratch import folder
    from barlake.streaming.features import STATE_STORE, live_features

    b, root = bars(spark, d), folder(spark, "live")
    new = F.col("close_time") > F.lit(LIVE_FROM).cast("timestamp")
    for part in range(3):
        of_part = F.dayofmonth("close_time").between(11 + 7 * part, 17 + 7 * part) if part < 2 else F.dayofmonth("close_time") >= 25
        b.where(new & (F.month("close_time") == 1) & of_part).coalesce(1).write.mode("append").parquet(f"{root}/bars")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars")
        job = live_features(stream, b.where(~new)).writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/features")
        job.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{root}/features")


LIVE_STRUCTURE = {k: v for k, v in STRUCTURE.items() if k != "range_width_atr"}


@query(f"SELECT * FROM ({WITH_ATR}, {SW2} {final(LIVE_STRUCTURE, 'p4', 4)}) WHERE close_at > '{LIVE_FROM}'")
def live_structure(spark, d):
    return told(live(spark, d), *LIVE_STRUCTURE, digits=4)


@query(f"SELECT * FROM ({ZONE_SQL}) WHERE close_at > '{LIVE_FROM}'")
def live_zones(spark, d):
    return told(live(spark, d), *zone_names())


def small(semantics: str = "reference"):
    from barlake.config import Config, Features, Frames

    return Config(base_timeframe="15m", features=Features(semantics=semantics, mtf=Frames(timeframes=("1h", "4h"))))


@query()
def feature_matrix_wide(spark, d):
    from barlake.plans.engine import transform

    return transform(bars(spark, d), small())[0]


@query()
def feature_matrix_default(spark, d):
    """The 583 columns of the default configuration: 5-minute bars with 15m, 1h, 4h and 1d."""
    from barlake.config import Config
    from barlake.plans.engine import transform

    return transform(bars(spark, d, 5), Config())[0]


@query("SELECT 'no feature differs' AS result, CAST(0 AS BIGINT) AS n_features")
def replay_audit(spark, d):
    """Features whose value at a past close differs when the bars after it are taken away: none may.

    Causal semantics: the reference's session statistics look at the whole series by definition.
    """
    from barlake.plans.engine import replay_audit as audit

    found = audit(bars(spark, d), small("causal"), n_cutoffs=6, raise_on_failure=False)
    return found.agg(F.when(F.count("*") == 0, "no feature differs").otherwise("features look ahead").alias("result"), F.countDistinct("feature").alias("n_features"))


@query(f"""WITH {EV}, {bars_sql(symbol="event_type")}, v AS (SELECT symbol, close_time, close, lead(close) OVER w AS next_close, lag(close) OVER w AS before_close FROM b WINDOW w AS (PARTITION BY symbol ORDER BY close_time)),
span AS (SELECT CAST(epoch(min(close_time)) AS BIGINT) AS a, CAST(epoch(max(close_time)) AS BIGINT) AS z FROM b),
cuts AS (SELECT a + (z - a) * (9 + 6 * k) // 48 AS cutoff FROM span, range(1, 7) AS r(k)),
ends AS (SELECT symbol, cutoff, max(close_time) AS close_time FROM b JOIN cuts ON epoch(close_time) <= cutoff GROUP BY ALL),
one AS (SELECT cutoff, symbol, close_time, 'next_close' AS feature, next_close AS was FROM ends JOIN v USING (symbol, close_time) WHERE next_close IS NOT NULL)
SELECT cutoff, symbol, strftime(close_time, '%Y-%m-%d %H:%M:%S') AS close_at, feature, round(was, {DIGITS}) AS with_later_bars, CAST(NULL AS DOUBLE) AS without FROM one""")
def replay_planted_leak(spark, d):
    """The comparison behind the replay audit, on a feature that looks ahead and on one that does not: what it finds, and
    where, is exactly the first."""
    from barlake.plans.engine import cutoffs_of, replay_differences

    b = bars(spark, d, by_type=True)
    make = lambda x: x.select("symbol", "close_time", F.lead("close").over(R.series()).alias("next_close"), R.lag("close").alias("before_close"))
    found = replay_differences(b, make, cutoffs_of(b, 6))
    return found.select("cutoff", "symbol", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("close_at"), "feature", F.round("full", DIGITS).alias("with_later_bars"), F.round("replayed", DIGITS).alias("without"))


@query()
def null_report(spark, d):
    from barlake.plans.engine import null_report as report
    from barlake.plans.engine import transform

    return report(transform(bars(spark, d), small())[0])


@query(f"WITH {EV}, {bars_sql()} SELECT symbol, '15m' AS tf, count(*) AS n_rows, strftime(min(close_time), '%Y-%m-%d %H:%M:%S') AS first_close, strftime(max(close_time), '%Y-%m-%d %H:%M:%S') AS last_close FROM b GROUP BY symbol")
def store_summary(spark, d):
    from barlake.sources.scratch import folder
    from barlake.sources import stores

    root = folder(spark, "bars")
    stores.write_bars(bars(spark, d), root, "15m")
    s = stores.store_summary(spark, root)
    return s.select("symbol", "tf", "n_rows", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_close", "last_close")))


@query(f"WITH {EV}, {bars_sql()} " + final({"close": "close"}, "b WHERE close_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"))
def date_range_scan(spark, d):
    from barlake.sources.scratch import folder
    from barlake.sources import stores

    root = folder(spark, "bars")
    stores.write_bars(bars(spark, d), root, "15m")
    return told(stores.read_bars(spark, root, "ALL", "15m", "2024-01-10", "2024-01-12"), "close")

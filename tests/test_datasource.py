import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlake.sources import datasource as D

T0 = dt.datetime(2026, 1, 5)


@pytest.fixture(scope="module")
def source(spark):
    D.register(spark)
    return lambda path, **options: spark.read.format("bars").options(path=f"file://{path}", **options).load()


def lines(n, form="%Y-%m-%d %H:%M:%S", sep=",", mark="."):
    return [sep.join([(T0 + dt.timedelta(minutes=5 * k)).strftime(form), *(f"{x:.2f}".replace(".", mark) for x in (10 + k, 11 + k, 9 + k, 10.5 + k)), str(k)]) for k in range(n)]


def wanted(n):
    return [(T0 + dt.timedelta(minutes=5 * k), T0 + dt.timedelta(minutes=5 * k + 5), 10.0 + k, 11.0 + k, 9.0 + k, 10.5 + k, float(k)) for k in range(n)]


def got(df):
    return [tuple(r) for r in df.orderBy("line").select("open_time", "close_time", "open", "high", "low", "close", "volume").collect()]


HEAD = "datetime,open,high,low,close,volume"


@pytest.mark.parametrize("split", [37, 64, 1000, 1 << 20])
def test_ranges_of_bytes_hold_each_line_once(source, tmp_path, split):
    (tmp_path / "b.csv").write_text("\n".join([HEAD, *lines(60)]))
    df = source(tmp_path / "b.csv", splitbytes=split)
    assert got(df) == wanted(60)
    assert df.rdd.getNumPartitions() == -(-len("\n".join(lines(60))) // split)


@pytest.mark.parametrize("text, options", [
    ("\ufeff" + "\n".join([HEAD, *lines(5)]) + "\n", {}),
    ("\r\n".join([HEAD.replace(",", ";"), *lines(5, sep=";", mark=",")]) + "\r\n", {"decimal": ","}),
    ("\n".join(["<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>", *lines(5, "%Y.%m.%d\t%H:%M:%S", "\t")]), {}),
    ("\n".join(lines(5, "%Y.%m.%d\t%H:%M:%S", "\t")), {}),
    ("\n".join(["made by hand", "", HEAD, *lines(5)]), {"skiprows": 2}),
    ("\n".join(["Gmt time,Close,Open,High,Low,Vol", *(",".join(x.split(",")[i] for i in (0, 4, 1, 2, 3, 5)) for x in lines(5))]), {}),
])
def test_dialects(source, tmp_path, text, options):
    (tmp_path / "b.csv").write_text(text, newline="")
    assert got(source(tmp_path / "b.csv", **options)) == wanted(5)


def test_folders_zones_and_conventions(source, tmp_path):
    for k, part in enumerate((lines(30)[:11], lines(30)[11:])):
        (tmp_path / f"{k}.csv").write_text("\n".join([HEAD, *part]))
    (tmp_path / "_SUCCESS").write_text("")
    df = source(tmp_path, convention="close", source_tz="Europe/Berlin", symbol="X")
    assert sorted(r.close_time for r in df.collect()) == [w[0] - dt.timedelta(hours=1) for w in wanted(30)]
    assert {r.symbol for r in df.collect()} == {"X"}


def test_filters_leave_rows_out_in_the_source(source, tmp_path):
    (tmp_path / "b.csv").write_text("\n".join([HEAD, *lines(300)]))
    at = F.lit(T0 + dt.timedelta(minutes=500))
    df = source(tmp_path / "b.csv", splitbytes=2000).where((F.col("close_time") > at) & (F.col("open_time") <= at + F.expr("INTERVAL 1 HOUR")) & (F.col("high") > 0))
    assert len(got(df)) == 13
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "close_time#" not in plan.split("Filter (")[1].split("BatchScan")[0].replace("isnotnull(close_time", "")
    reader = D.BarsReader({"path": str(tmp_path / "b.csv")})
    kept = [D.GreaterThan(("close_time",), T0), D.EqualTo(("symbol",), "ALL")]
    back = [D.GreaterThan(("high",), 1.0), D.EqualTo(("symbol", "x"), "ALL")]
    assert list(reader.pushFilters([*kept, *back])) == back and reader.filters == kept
    assert source(tmp_path / "b.csv", symbol="A").where("symbol = 'B'").count() == 0


def test_odd_files(source, tmp_path):
    (tmp_path / "only_head.csv").write_text(HEAD + "\n")
    assert source(tmp_path / "only_head.csv").count() == 0
    (tmp_path / "holes.csv").write_text("\n".join([HEAD, lines(2)[0], "", "2026-01-05 00:05:00,,x,9,10,", ""]))
    rows = source(tmp_path / "holes.csv").orderBy("line").collect()
    assert len(rows) == 2 and (rows[1].open, rows[1].high, rows[1].low, rows[1].volume) == (None, None, 9.0, None)
    for name, text in (("bad.csv", "a,b\n1,2\n"), ("when.csv", HEAD + "\nsoon,1,2,0,1,1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="dialect|stamps"):
            source(tmp_path / name).count()

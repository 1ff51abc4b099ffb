import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("w")), "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def rows(df_rows, cols):
    return sorted((tuple(plain(r[c]) for c in cols) for r in df_rows), key=repr)


def against_oracle(spark, f, sql, d=SMALL):
    """Rows of a query equal those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got, want = f(spark, d), con.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    named = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(got.collect(), cols) == rows(named, cols)

import pytest
from conftest import against_oracle

from barlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_its_sql(spark, name):
    against_oracle(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_engine_without_corpus_package(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)

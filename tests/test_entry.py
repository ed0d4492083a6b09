import importlib

import pytest


def test_entry_and_sql_names(spark):
    e = importlib.import_module("__spark_entry__")
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(sql) > 100


@pytest.mark.parametrize("name", ["length_match_10w", "roc_auc", "dedup_fingerprint"])
def test_some_queries_run(spark, name):
    e = importlib.import_module("__spark_entry__")
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0

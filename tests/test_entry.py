import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.limit(5).count() > 0
    assert {"ticker", "date", "RSI", "fwd_log_ret_10"} <= set(df.columns)

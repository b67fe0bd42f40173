import datetime as dt
import os

from panelspark.functions import round_doubles
from panelspark.sources import bars as B

LI = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
      "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
      "l_shipdate timestamp_ntz")


def _bars(spark, tmp_path, rows):
    path = str(tmp_path / "tables")
    os.makedirs(path)
    spark.createDataFrame(rows, LI).write.parquet(os.path.join(path, "lineitem.parquet"))
    return round_doubles(B.bars_from_lineitem(spark, path, "flags"), 9)


def test_trades_of_one_line_come_in_order_of_price(spark, tmp_path):
    day = dt.datetime(1996, 3, 1)
    rows = []
    for ok, ln, pk, sk, ep, q in [(5, 1, 9, 3, 100.0, 2.0), (5, 1, 7, 3, 90.0, 3.0), (5, 1, 7, 2, 80.0, 4.0),
                                  (9, 2, 1, 1, 50.5, 5.0), (9, 2, 1, 1, 60.25, 5.0), (1, 7, 4, 4, 10.0, 1.0),
                                  (1, 7, 4, 4, 9.0, 1.0)]:
        rows.append((ok, pk, sk, ln, q, ep, 0.0, 0.0, "A", "F", day))
    r = _bars(spark, tmp_path, rows).collect()[0]
    assert r["open"] == 9.0 and r["close"] == round(60.25 / 5.0, 9)


def test_large_and_negative_order_numbers_keep_their_order(spark, tmp_path):
    day = dt.datetime(1996, 3, 1)
    big = [(999_999_999_998, 1, 5.0), (999_999_999_999, 1, 6.0), (-3, 2, 7.0), (2 ** 63 - 1, 2_000_000_000, 8.0)]
    rows = [(ok, 1, 1, ln, 1.0, p, 0.0, 0.0, "A", "F", day) for ok, ln, p in big]
    out = _bars(spark, tmp_path, rows)
    r = out.collect()[0]
    assert r["open"] == 7.0 and r["close"] == 8.0
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_trades_without_a_price_are_left_out(spark, tmp_path):
    day = dt.datetime(1996, 3, 1)
    rows = [(ok, 1, 1, 1, q, p, 0.0, 0.0, "A", "F", day) for ok, q, p in [(1, 0.0, 5.0), (2, 2.0, 8.0), (3, 4.0, 12.0), (4, None, 1.0), (5, 3.0, None), (6, 0.0, 0.0)]]
    r = _bars(spark, tmp_path, rows).collect()
    assert [(x["open"], x["close"], x["vol"]) for x in r] == [(4.0, 3.0, 6.0)]

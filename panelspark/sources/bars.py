"""Daily OHLCV bars derived from a trade table (one trade = one lineitem row).

A bar per (ticker, date): open/close are the price of the first/last trade in a
fixed order of the trades, high/low the extreme prices, vol the summed
quantity. Everything is a hash aggregate with a map-side partial step, so a hot
ticker (even one third of all trades) is combined inside each map task before
the shuffle and never gathered into one task.

When the ticker comes from a dimension (supplier or nation), the trades are
first reduced to bars per (l_suppkey, date) and only those bars are joined to
the dimension, then merged again per (ticker, date): the join sees bars, not
trades.

The trade order is (order number, line number, unit price in cents), packed into
one DECIMAL(38,0) key by the columns' types: 19 digits for the 64-bit order
number, 10 for the 32-bit line number, 9 for the price. ``min_by`` / ``max_by``
on a large decimal run as hash aggregates (struct-valued buffers would plan a
sort aggregate), and the plan is the same for every input.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import safe_div

PANELS = ("flags", "nation", "supplier")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_DEC = "decimal(38,0)"


def trade_key() -> Column:
    """(l_orderkey, l_linenumber, unit price in cents) as one ordered number.

    Trades of one order line on one bar come in order of price; two that agree
    to the cent are interchangeable. Prices beyond 9,999,999.99 count as that.
    """
    line = F.col("l_linenumber").cast("long") + F.lit(2 ** 31)
    cents = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(999_999_999.0), safe_div("l_extendedprice", "l_quantity") * 100.0)))
    key = F.col("l_orderkey").cast(_DEC) * F.lit(10 ** 10).cast("decimal(11,0)")
    key = (key.cast(_DEC) + line.cast(_DEC)).cast(_DEC) * F.lit(10 ** 9).cast("decimal(10,0)")
    return (key.cast(_DEC) + cents.cast("long").cast(_DEC)).cast(_DEC)


def _trades(lineitem: DataFrame) -> DataFrame:
    """Trades with a price; one of quantity 0 or without quantity or price has none and is left out."""
    return lineitem.filter("l_quantity <> 0 and l_extendedprice is not null").select(
        "l_returnflag", "l_linestatus", "l_suppkey", F.to_date("l_shipdate").alias("date"),
        safe_div("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity"),
        trade_key().alias("k"))


def _partial_bars(trades: DataFrame, keys: list) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.min("k").alias("k_first"), F.min_by("price", "k").alias("p_first"),
        F.max("k").alias("k_last"), F.max_by("price", "k").alias("p_last"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("vol"))


def _merge_bars(partial: DataFrame, ticker_col: str) -> DataFrame:
    return partial.groupBy(F.col(ticker_col).alias("ticker"), "date").agg(
        F.min_by("p_first", "k_first").alias("p_first"), F.max_by("p_last", "k_last").alias("p_last"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("vol").alias("vol"))


def _finish(bars: DataFrame) -> DataFrame:
    return bars.select(F.col("ticker").cast("string").alias("ticker"), "date", F.col("p_first").alias("open"),
                       "high", "low", F.col("p_last").alias("close"), F.col("vol").cast("double").alias("vol"))


def bars_from_lineitem(spark: SparkSession, sf_dir: str, panel: str = "flags") -> DataFrame:
    """OHLCV panel ``ticker, date, open, high, low, close, vol``.

    ``panel``: ``flags`` (ticker = returnflag||linestatus), ``supplier``
    (ticker = s_name) or ``nation`` (ticker = n_name of the supplier).
    """
    if panel not in PANELS:
        raise ValueError(f"unknown panel {panel!r}; expected one of {PANELS}")
    trades = _trades(read_table(spark, sf_dir, "lineitem"))
    if panel == "flags":
        return _finish(_partial_bars(trades, ["l_returnflag", "l_linestatus", "date"])
                       .withColumn("ticker", F.concat("l_returnflag", "l_linestatus")))
    by_supp = _partial_bars(trades, ["l_suppkey", "date"])
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = by_supp.join(supplier, by_supp.l_suppkey == supplier.s_suppkey, "inner")
    if panel == "supplier":
        return _finish(_merge_bars(joined, "s_name"))
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = joined.join(nation, joined.s_nationkey == nation.n_nationkey, "inner")
    return _finish(_merge_bars(joined, "n_name"))

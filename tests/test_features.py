import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panel_helpers import PANEL, d, make_panel, walk
from panelspark.functions import round_doubles
from panelspark.operators import features as FE
from panelspark.operators import labels as LB


def by_key(df, col):
    return {(r["ticker"], r["date"]): r[col] for r in df.select("ticker", "date", col).collect()}


def test_rank_average_ties_and_nulls(spark):
    rows = [("A", d(0), 1.0, 1.0, 1.0, 100.0, 1.0), ("A", d(1), 1.0, 1.0, 1.0, 110.0, 1.0),
            ("B", d(0), 1.0, 1.0, 1.0, 100.0, 1.0), ("B", d(1), 1.0, 1.0, 1.0, 110.0, 1.0),
            ("C", d(0), 1.0, 1.0, 1.0, 100.0, 1.0), ("C", d(1), 1.0, 1.0, 1.0, 120.0, 1.0),
            ("D", d(1), 1.0, 1.0, 1.0, 50.0, 1.0)]
    df = spark.createDataFrame(rows, PANEL)
    got = by_key(FE.cross_section_rank(FE.returns(df, (1,)), ["ret_1"]), "ret_rel_perc_1")
    assert got[("A", d(1))] == pytest.approx(1.5 / 3 * 20)
    assert got[("B", d(1))] == pytest.approx(1.5 / 3 * 20)
    assert got[("C", d(1))] == pytest.approx(20.0)
    assert got[("D", d(1))] is None


def test_flat_series(spark):
    rows = [("F", d(i), 10.0, 10.0, 10.0, 10.0, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, PANEL)
    x = FE.variance_ratio(FE.ibs(FE.technical_indicators(df, keep_atr=True)))
    r = x.filter(F.col("date") == d(39)).first()
    assert r["ibs"] is None
    assert r["RSI"] == 0.0 and r["NATR"] == 0.0 and r["_atr"] == 0.0
    assert r["var_ratio_3"] is None


def _wilder_loop(x, n=14):
    out = [None] * len(x)
    if len(x) <= n:
        return out
    y = sum(x[1:n + 1]) / n
    out[n] = y
    for i in range(n + 1, len(x)):
        y = ((n - 1) * y + x[i]) / n
        out[i] = y
    return out


def test_rsi_atr_match_recursion(spark):
    closes = walk(400, seed=3)
    df = make_panel(spark, {"W": closes})
    got = FE.technical_indicators(df, keep_atr=True).orderBy("date").collect()
    gains = [0.0] + [max(closes[i] - closes[i - 1], 0.0) for i in range(1, len(closes))]
    losses = [0.0] + [max(closes[i - 1] - closes[i], 0.0) for i in range(1, len(closes))]
    g, l = _wilder_loop(gains), _wilder_loop(losses)
    for i, row in enumerate(got):
        if g[i] is None:
            assert row["RSI"] is None
        else:
            exp = 0.0 if g[i] + l[i] == 0 else 100 * g[i] / (g[i] + l[i])
            assert row["RSI"] == pytest.approx(exp, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n", [13, 14, 15, 20, 21])
def test_first_valid_rows(spark, n):
    df = make_panel(spark, {"S": walk(n, seed=n)})
    x = LB.forward_volatility(FE.technical_indicators(df), (3,)).orderBy("date").collect()
    rsi_rows = [i for i, r in enumerate(x) if r["RSI"] is not None]
    bb_rows = [i for i, r in enumerate(x) if r["bbu"] is not None]
    assert rsi_rows == list(range(14, n))
    assert bb_rows == list(range(19, n))
    vola = [i for i, r in enumerate(x) if r["fwd_vola_03"] is not None]
    assert vola == [i for i in range(20, n - 3)]


def test_weekend_encoding(spark):
    sat, sun, mon = dt.date(2020, 1, 4), dt.date(2020, 1, 5), dt.date(2020, 1, 6)
    df = spark.createDataFrame([("W", x, 1.0, 1.0, 1.0, 1.0, 1.0) for x in (sat, sun, mon)], PANEL)
    got = {r["date"]: (r["weekday_sin"], r["weekday_cos"]) for r in FE.calendar_features(df).collect()}
    assert got[sat] == pytest.approx((0.0, 1.0))
    assert got[mon] == pytest.approx((0.0, 1.0))
    assert got[sun] == pytest.approx((math.sin(2 * math.pi / 5), math.cos(2 * math.pi / 5)))


def test_calendar_barrier_uses_calendar_days(spark):
    # trading days 0, 1, 4, 5: from day 1 the first date >= day 1 + 3 is day 4
    rows = [("B", d(i), 1.0, 1.0, 1.0, 10.0 + i, 1.0) for i in (0, 1, 4, 5)]
    df = spark.createDataFrame(rows, PANEL)
    got = by_key(LB.vertical_barrier(df, 3), "t1")
    assert got[("B", d(1))] == d(4)
    assert got[("B", d(4))] == d(5)   # none >= day 7: the last date
    assert got[("B", d(5))] == d(5)


def test_frac_weights():
    w = FE.frac_weights(0.4, 5)
    assert w[0] == 1.0 and w[1] == pytest.approx(-0.4)
    assert w[2] == pytest.approx(-0.4 * -0.6 / 2 * -1)


def test_order_independence_and_tickers_isolated(spark):
    series = {t: walk(150, seed=i) for i, t in enumerate("ABC")}
    df = make_panel(spark, series)
    rows = df.collect()
    random.Random(7).shuffle(rows)
    shuffled = spark.createDataFrame(rows, PANEL).repartition(5)
    a = round_doubles(FE.feature_label_block(df, frac_width=20), 9)
    b = round_doubles(FE.feature_label_block(shuffled, frac_width=20), 9)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # adding a ticker does not change per-ticker features of the others
    more = make_panel(spark, {**series, "Z": walk(150, seed=99)})
    cols = [c for c in a.columns if not c.startswith("ret_rel_perc")]
    c = round_doubles(FE.feature_label_block(more, frac_width=20), 9).filter("ticker != 'Z'").select(*cols)
    assert c.exceptAll(a.select(*cols)).count() == 0


def test_no_look_ahead(spark):
    series = {t: walk(160, seed=10 + i) for i, t in enumerate("AB")}
    df = make_panel(spark, series)
    cut = d(120)
    full = FE.feature_label_block(df, frac_width=20).filter(F.col("date") <= cut)
    trunc = FE.feature_label_block(df.filter(F.col("date") <= cut), frac_width=20)
    feats = [c for c in FE.FEATURE_COLUMNS]
    a, b = round_doubles(full.select("ticker", "date", *feats), 9), round_doubles(trunc.select("ticker", "date", *feats), 9)
    assert a.exceptAll(b).count() == 0
    labels = [c for c in LB.TARGET_COLUMNS if not c.startswith("dl_")]
    la, lb_ = full.select("ticker", "date", *labels), trunc.select("ticker", "date", *labels)
    assert la.exceptAll(lb_).count() > 0  # labels must look ahead


def test_fused_equals_operators(spark):
    df = make_panel(spark, {t: walk(140, seed=20 + i) for i, t in enumerate("ABCD")})
    fused = FE.feature_label_block(df, frac_width=30)
    x = FE.global_features(df, rank=False, frac_width=30)
    x = FE.cross_section_rank(LB.add_targets(x)).drop("open", "high", "low", "close", "vol")
    cols = sorted(fused.columns)
    assert cols == sorted(x.columns)
    a, b = round_doubles(fused.select(*cols), 9), round_doubles(x.select(*cols), 9)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_triple_barrier_first_touch(spark):
    closes = [100.0] * 55 + [100.0, 130.0, 60.0, 100.0]
    # add noise early so the 50-row volatility is positive
    closes = [c * (1 + 0.01 * ((i % 3) - 1)) if i < 55 else c for i, c in enumerate(closes)]
    df = make_panel(spark, {"T": closes})
    x = LB.triple_barrier(df, t=3, pt=1.0, sl=1.0, vol_n=50, min_ret=0.0).orderBy("date").collect()
    r = x[55]
    assert r["tb_label"] == 1.0 and r["tb_exit"] == d(56)


def test_null_close_at_the_barrier_stays_null(spark):
    df = make_panel(spark, {"A": [10.0 + i for i in range(8)]})
    days = [r["date"] for r in df.orderBy("date").collect()]
    holed = df.withColumn("close", F.when(F.col("date") != F.lit(days[3]), F.col("close")))
    r = {x["date"]: x for x in LB.vertical_barrier(holed, (days[3] - days[0]).days).collect()}[days[0]]
    assert r["t1"] == days[3] and r["t1_close"] is None


def test_rank_needs_one_sort_per_column(spark):
    df = make_panel(spark, {t: walk(30, seed=i) for i, t in enumerate("ABC")})
    x = FE.cross_section_rank(FE.returns(df), ["ret_1", "ret_3"])
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_date = [line for line in plan.split("\n") if " Sort [date" in line]
    assert len(by_date) == 2


def test_one_long_series_through_the_default_operators(spark):
    n = 20_000
    closes = walk(n, seed=11)
    df = make_panel(spark, {"L": closes})
    got = [r["_atr"] for r in FE.technical_indicators(df, keep_atr=True).orderBy("date").select("_atr").collect()]
    rows = df.orderBy("date").collect()
    tr = [0.0] + [max(r["high"] - r["low"], abs(r["high"] - p["close"]), abs(r["low"] - p["close"]))
                  for p, r in zip(rows, rows[1:])]
    ref = _wilder_loop(tr)
    assert len(got) == n and got[:14] == [None] * 14
    for i in [14, 15, 4095, 4096, 4097, 9001, 12288, 19999]:
        assert got[i] == pytest.approx(ref[i], rel=1e-9)
    block = FE.feature_label_block(df, frac_width=20, rank=False).orderBy("date").select("NATR").collect()
    assert block[19_000]["NATR"] == pytest.approx(100 * ref[19_000] / rows[19_000]["close"], rel=1e-9)


def test_blocked_wilder_carries_across_blocks(spark):
    from panelspark.functions import wilder_blocked
    rnd = random.Random(4)
    xs = [abs(rnd.gauss(1, 1)) for _ in range(1900)]
    df = spark.createDataFrame([("A", i, x, i) for i, x in enumerate(xs)], "ticker string, date int, x double, _i int")
    got = [r["y"] for r in wilder_blocked(df, {"x": "y"}, "_i", 14, block=600).orderBy("date").collect()]
    ref = _wilder_loop(xs)
    assert got[:14] == [None] * 14
    for g, e in zip(got[14:], ref[14:]):
        assert g == pytest.approx(e, rel=1e-12)
    with pytest.raises(ValueError):
        wilder_blocked(df, {"x": "y"}, "_i", 14, block=128)


def test_rank_tasks_hold_a_few_days(spark):
    """Small partitions were merged before the sorts, one of which each column adds: one task held many days' rows."""
    df = make_panel(spark, {t: walk(60, seed=i) for i, t in enumerate("ABC")})
    x = FE.cross_section_rank(FE.returns(df), ["ret_1", "ret_3"])
    days = [len({r["date"] for r in part}) for part in x.select("date").rdd.glom().collect()]
    assert len(days) == FE.RANK_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(days) == 60
    assert max(days) <= 15  # merged: all 60

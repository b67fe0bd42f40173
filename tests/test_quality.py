import pytest
from pyspark.sql import functions as F

from panel_helpers import PANEL, d
from panelspark.operators import quality as Q


def _days(spark, n):
    return spark.createDataFrame([(d(i),) for i in range(n)], "date date")


def test_gaps_ffill_and_stats(spark):
    # G: holes of 3 days (3..5) and 4 days (9..12); E ends early; S has one row
    present = {"G": [0, 1, 2, 6, 7, 8, 13, 14], "E": [0, 1, 2, 3], "S": [5]}
    rows = [(t, d(i), 1.0, 2.0, 0.5, 1.0 + i, 10.0) for t, idx in present.items() for i in idx]
    df = spark.createDataFrame(rows, PANEL)
    days = _days(spark, 15)
    dense = Q.densify(df, days, fill_tail=3)
    filled = {(r["ticker"], r["date"]): r["close"] for r in Q.ffill_limit(dense, 3).collect()}
    assert filled[("G", d(5))] == 3.0          # 3-day hole fully filled from day 2
    assert filled[("G", d(11))] == 9.0 and filled[("G", d(12))] is None  # 4th day of the 4-day hole
    assert filled[("E", d(6))] == 4.0 and ("E", d(7)) not in filled      # fill limit after the last day
    stats = {r["ticker"]: r for r in Q.gap_stats(df, days).collect()}
    assert stats["G"]["inner_gaps"] == 7 and stats["G"]["total_days"] == 14
    assert stats["G"]["gap_pct"] == pytest.approx(50.0)
    assert stats["S"]["total_days"] == 0 and stats["S"]["gap_pct"] == 0.0


def test_bad_rows(spark):
    rows = [("B", d(0), 1.0, 1.0, 2.0, 1.0, 1.0),     # high < low
            ("B", d(1), 1.0, 2.0, 1.0, -1.0, 1.0),    # negative close
            ("B", d(2), 1.0, 2.0, 1.0, 1.0, -5.0),    # negative volume
            ("B", d(3), 1.0, 2.0, 1.0, 1.0, None),    # missing volume: kept
            ("B", d(4), None, 2.0, 1.0, 1.0, 1.0),    # incomplete OHLC
            ("B", d(5), 1.0, 2.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, PANEL)
    kept = sorted(r["date"] for r in Q.drop_invalid_ohlc(Q.drop_incomplete_ohlc(df)).collect())
    assert kept == [d(3), d(5)]


def test_ghost_day(spark):
    rows = []
    for i in range(30):
        n = 3 if i == 15 else 10
        rows += [(f"T{k}", d(i), 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, PANEL)
    g = {r["date"]: r["is_valid"] for r in Q.ghost_days(df).collect()}
    assert g[d(15)] is False
    assert sum(1 for v in g.values() if not v) == 1


def test_liquidity_and_flags(spark):
    rows = [(t, d(i), 1.0, 1.0, 1.0, px, vol) for t, px, vol in (("A", 20.0, 300000.0), ("B", 5.0, 300000.0))
            for i in range(50)]
    df = spark.createDataFrame(rows, PANEL)
    stats = Q.liquidity_stats(df)
    flags = {r["ticker"]: r for r in Q.liquidity_flags(stats).collect()}
    assert flags["A"]["is_valid"] and not flags["B"]["is_price_ok"]
    assert flags["B"]["is_vol_ok"] and not flags["B"]["is_dvol_ok"]
    assert Q.keep_liquid(df, Q.liquidity_flags(stats)).select("ticker").distinct().collect()[0][0] == "A"


def test_period_start_tie_smallest_year(spark):
    import datetime as dt
    rows = [("A", dt.date(2001, 5, 1)), ("B", dt.date(2002, 5, 1)), ("C", dt.date(2003, 1, 1))]
    df = spark.createDataFrame([(t, x, 1.0, 1.0, 1.0, 1.0, 1.0) for t, x in rows], PANEL)
    r = Q.infer_period_start(df).first()
    assert r["start_year"] == 2001 and str(r["period_start"]) == "2002-01-01"


def test_densify_has_no_cross_join(spark):
    df = spark.createDataFrame([("A", d(0), 1.0, 1.0, 1.0, 1.0, 1.0)], PANEL)
    plan = Q.densify(df, _days(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("window", [5, 6])
def test_liquidity_medians_against_pandas(spark, window):
    import random
    rnd = random.Random(window)
    rows = []
    for t, n in (("A", 40), ("B", window), ("C", window - 1)):
        for i in range(n):
            close = rnd.choice([1.0, 2.0, 2.5, 7.0])
            rows.append((t, d(i), close, close, close, close, None if t == "A" and i % 11 == 0 else float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, PANEL)
    got = {r["ticker"]: r for r in Q.liquidity_stats(df.repartition(3), window).collect()}
    pdf = df.toPandas().sort_values(["ticker", "date"])
    pdf["dollar_vol"] = pdf["close"] * pdf["vol"]
    for t, g in pdf.groupby("ticker"):
        for c, out in (("close", "med_price"), ("vol", "med_vol"), ("dollar_vol", "med_dvol")):
            want = g[c].rolling(window).median().min()
            assert got[t][out] is None if want != want else got[t][out] == pytest.approx(want), (t, c)


def test_clean_panel_works_its_input_out_once(spark):
    """The job reads its input for one table; everything after it reads what was written."""
    from panelspark.plans.jobs import clean_panel
    rows = [(t, d(i), 50.0, 60.0, 40.0, 50.0 + i % 3, 1e6) for t in "AB" for i in range(120) if not (t == "B" and i % 40 == 7)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    raw = spark.createDataFrame(rows, PANEL).mapInArrow(count, PANEL)
    out = clean_panel(raw, start="2000-01-01", period_start="2000-01-01", gap_threshold=50.0)
    assert out.panel.count() > 0 and out.ticker_stats.count() == 2 and out.gap_stats.count() == 2
    assert seen.value == len(rows)


def test_only_the_days_a_fill_reaches(spark):
    """A sparse ticker's grid was its whole life span, though all days a fill cannot reach are dropped after it."""
    present = {"G": [0, 1, 2, 6, 7, 8, 13, 14], "E": [0, 1, 2, 3], "S": [5], "L": [0, 28]}
    rows = [(t, d(i), 1.0, 2.0, 0.5, None if i in (6, 14) else 1.0 + i, None if i == 7 else 10.0) for t, idx in present.items() for i in idx]
    rows += [("D", d(1), 1.0, 2.0, 0.5, 3.0, 1.0), ("D", d(1), 1.0, 2.0, 0.5, 3.0, 1.0), (None, d(2), 1.0, 2.0, 0.5, 4.0, 1.0)]
    df = spark.createDataFrame(rows, PANEL)
    days = _days(spark, 30)
    for limit in (1, 3):
        whole, near = Q.densify(df, days, fill_tail=limit), Q.densify(df, days, fill_tail=limit, reach=limit)
        # days 0 and 28, the days after day 0, and day 29, after which there is none
        assert near.filter("ticker = 'L'").count() == 2 + limit + 1 and near.count() < whole.count()
        a, b = (Q.drop_incomplete_ohlc(Q.ffill_limit(x, limit)) for x in (whole, near))
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.exceptAll(a.select(*b.columns)).count() == 0


def test_liquidity_medians_over_batches(spark):
    """Frames of each row were built as sorted arrays in the JVM; now tasks slide over batches, also over small ones."""
    rows = [(t, d(i), 1.0, 1.0, 1.0, float((i * 7 + k) % 13), None if k == 1 and i == 30 else float((i * 5) % 11))
            for k, t in enumerate(("A", "B", None)) for i in range(60)]
    rows += [("N", d(i), 1.0, 1.0, 1.0, float("nan") if i < 9 else 2.0, float("nan")) for i in range(10)]
    df = spark.createDataFrame(rows, PANEL)
    whole = sorted(Q.liquidity_stats(df, 5).collect(), key=str)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert str(sorted(Q.liquidity_stats(df, 5).collect(), key=str)) == str(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r["ticker"]: r for r in whole}
    import statistics
    for k, t in enumerate(("A", "B", None)):
        close = [float((i * 7 + k) % 13) for i in range(60)]
        assert got[t]["med_price"] == min(statistics.median(close[i - 4:i + 1]) for i in range(4, 60))
    assert got["N"]["med_price"] != got["N"]["med_price"] and got["N"]["med_vol"] != got["N"]["med_vol"]
    assert " Window" not in Q.liquidity_stats(df, 5)._jdf.queryExecution().optimizedPlan().toString()

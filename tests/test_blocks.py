import pytest
from pyspark.sql import functions as F

from panel_helpers import d, make_panel, walk
from panelspark.functions import round_doubles
from panelspark.operators import blocks as BL
from panelspark.operators import features as FE
from panelspark.operators import labels as LB


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = a.select(*cols), b.select(*cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def panel(spark):
    p = make_panel(spark, {"L": walk(2600, 5), "M": walk(650, 6), "S": walk(12, 7), "T": walk(1, 8)})
    return p.repartition(5).cache()


def test_rows_are_numbered_across_stretches(spark, panel):
    from pyspark.sql import Window
    want = panel.withColumn("_i", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).cast("long"))
    same(BL.number_rows(panel, stretch_days=100), want)


def test_fused_plan_does_not_depend_on_blocks(panel):
    whole = FE.feature_label_block(panel, block=8192)
    same(round_doubles(FE.feature_label_block(panel, block=700), 9), round_doubles(whole, 9))


@pytest.mark.parametrize("op", [
    FE.returns, lambda x: FE.technical_indicators(x, keep_atr=True), lambda x: FE.frac_returns(FE.momentum_ratio(FE.variance_ratio(x))), FE.parkinson,
    lambda x: LB.forward_returns(x), lambda x: LB.triple_barrier(x, t=10)], ids=["returns", "indicators", "ratios", "parkinson", "forward", "triple_barrier"])
def test_operators_in_blocks_equal_whole_series(panel, op):
    same(round_doubles(BL.in_blocks(panel, op, block=700), 9), round_doubles(op(panel), 9))


def test_one_long_series_is_many_tasks(spark):
    """300,000 daily rows of one ticker: no task of the windows sees more than some blocks."""
    n = 300_000
    days = spark.range(n).select(F.lit("A").alias("ticker"), F.date_add(F.lit("1200-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 (100 + 10 * F.sin(F.col("id") / 50.0) + F.pmod(F.col("id") * 7919, F.lit(101)) / 50.0).alias("close"))
    days = days.select("ticker", "date", F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", F.lit(1.0).alias("vol"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        x = FE.feature_label_block(days, rank=False)
        per = [r["n"] for r in x.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    assert sum(per) == n and len(per) >= 12 and max(per) <= 8 * BL.BLOCK


def test_halo_must_fit_the_windows(panel):
    with pytest.raises(ValueError):
        FE.feature_label_block(panel, frac_width=900)
    with pytest.raises(ValueError):
        BL.with_blocks(BL.number_rows(panel), block=100)


def test_window_columns_match_sparks_windows(spark):
    """Groups that cross Arrow batches, NULLs, a group without ticker, frames longer than a group."""
    import random

    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = [(t, b, d(i), None if rnd.random() < 0.1 else rnd.choice([1.0, 2.0, rnd.gauss(0, 3)]), rnd.randint(0, 1))
            for t, b, n in (("A", 0, 40), ("A", 1, 9), (None, 0, 25), ("B", 0, 1), ("C", 2, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, _b long, date date, x double, u int").repartition(3)
    w = Window.partitionBy("ticker", "_b").orderBy("date")

    def full(agg, k):
        f = w.rowsBetween(1 - k, 0)
        return F.when(F.count("x").over(f) == k, agg("x").over(f))
    want = df.select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("row"), F.lag("x", 2).over(w).alias("lag"), F.lead("date", 3).over(w).alias("lead"),
        F.last("x").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("last"), full(F.avg, 4).alias("mean"), full(F.var_samp, 5).alias("var"),
        full(F.stddev_samp, 3).alias("std"), full(F.stddev_pop, 6).alias("std_pop"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
        F.when(F.count("u").over(w.rowsBetween(-3, 0)) == 4, F.sum("u").over(w.rowsBetween(-3, 0))).cast("double").alias("sum"),
        (F.col("x") + F.lag("u", 2).over(w) + F.lag("x", 4).over(w)).alias("staggered")) \
        .withColumn("later", F.lag("mean", 1).over(w))
    specs = [("row", "row", None, 0), ("lag", "lag", "x", 2), ("lead", "lead", "date", 3), ("last", "last", "x", 0), ("mean", "mean", "x", 4),
             ("var", "var", "x", 5), ("std", "std", "x", 3), ("std_pop", "std_pop", "x", 6), ("running", "running", "x", 0), ("sum", "sum", "u", 4),
             ("staggered", "staggered", ["x", "u", "x"], 2), ("later", "lag", "mean", 1)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = BL.window_columns(df.repartition(2, "ticker", "_b").sortWithinPartitions("ticker", "_b", "date"), specs).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert sorted(map(str, got)) == sorted(map(str, want.collect()))


def test_feature_block_runs_no_sliding_frames(spark):
    """Every frame of every row was gone through by the JVM."""
    df = make_panel(spark, {"A": walk(30)})
    plan = FE.feature_label_block(df, frac_width=20, rank=False)._jdf.queryExecution().optimizedPlan().toString()
    assert " Window" not in plan and "MapInArrow" in plan


def test_rounding_agrees_with_sparks_round(spark):
    xs = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, -0.3, 0.0, -0.0, 1e20, -7.25, 4503599627370495.5, float("inf"), float("nan"), None, 0.125, 0.375]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (0, 2, 6):
        want = df.select("i", (F.round(F.col("x") * float(10 ** digits), 0) / float(10 ** digits) + 0.0).alias("x"))
        got = round_doubles(df, digits)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert " round(" not in got._jdf.queryExecution().optimizedPlan().toString()

"""What the long jobs leave on the disk while they run."""

import os

import pytest
from pyspark.sql import functions as F

from panel_helpers import make_panel, walk
from panelspark.operators import features as FE
from panelspark.operators import models as ML
from panelspark.plans import jobs, queries
from panelspark.session import checkpoint_dir, cut_lineage


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in blocks.mkString("\n").split("\n") if os.path.basename(f).startswith("shuffle_")}


def tables(spark):
    at = os.path.join(checkpoint_dir(spark), "tables")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_written_table_keeps_no_shuffle(spark):
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    x = cut_lineage(spark.range(1000).repartition(5, "id"), "own_rows")
    assert not shuffle_files(spark) - before
    assert x.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_the_feature_plan_holds_one_step_at_a_time(spark):
    """Bars, row numbers and ranks: their shuffles and all tables but the last stayed to the end."""
    panel = make_panel(spark, {"A": walk(60, 1), "B": walk(60, 2)}).repartition(3, "date")
    files, kept = shuffle_files(spark), tables(spark)
    x = FE.feature_label_block(panel, frac_width=20)
    assert not shuffle_files(spark) - files
    assert [t.split("_")[0] for t in tables(spark) - kept] == ["ranked"]
    assert x.count() == x.count() == 120


@pytest.fixture
def odd(spark, monkeypatch):
    """A panel whose features have NULL, NaN and one sparse column each among features and targets."""
    block = FE.feature_label_block

    def holed(*a, **kw):
        x = block(*a, **kw)
        day = F.dayofyear("date")
        return x.withColumn("RSI", F.when(day % 7 != 0, F.col("RSI"))).withColumn("ibs", F.when(day % 11 == 0, F.lit(float("nan"))).otherwise(F.col("ibs"))) \
            .withColumn("bbu", F.when(day % 5 == 0, F.col("bbu"))).withColumn("fwd_ret_05", F.when(day % 5 == 0, F.col("fwd_ret_05")))

    monkeypatch.setattr(jobs.FE, "feature_label_block", holed)
    return make_panel(spark, {"A": walk(200, 1), "B": walk(190, 2)})


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("bits", [62, 7])
def test_a_narrow_feature_table_is_the_wide_ones_columns(odd, monkeypatch, bits):
    monkeypatch.setattr(jobs, "BITS", bits)
    want, *names = jobs.feature_table(odd)
    assert {"bbu", "fwd_ret_05"} <= set(names[2]) and 0 < want.count() < 300
    for read in (("RSI", "NATR"), (), ("bbu", "ibs", "fwd_ret_05", "fwd_log_ret_10", "month")):
        got, *own = jobs.feature_table(odd, read.__contains__)
        assert own == names
        assert got.columns == ["ticker", "date", *[c for c in want.columns if c in read], "_whole"]
        assert rows(got.drop("_whole")) == rows(want.select("ticker", "date", *[c for c in want.columns if c in read]))
        assert {r["_whole"] for r in got.collect()} == {1}


def test_a_table_that_is_read_once_is_not_written(spark, odd):
    want, *names = jobs.feature_table(odd)
    kept = tables(spark)
    got, *own = jobs.feature_table(odd, again=True)
    assert own == names and rows(got) == rows(want)
    assert [t.split("_")[0] for t in tables(spark) - kept] == ["ranked"]


def test_queries_write_what_they_read(spark, monkeypatch):
    """``model_table`` wrote every feature and target first, the fits of lags as well."""
    seen, narrow = [], jobs._narrow_feature_table
    monkeypatch.setattr(jobs, "_narrow_feature_table", lambda x, read, once: narrow(x, read, lambda df: (seen.append(df.columns), once(df))[1]))
    monkeypatch.setattr(queries, "_bars", lambda *a: make_panel(spark, {"A": walk(160, 1)}))
    kept = tables(spark)
    queries.q_model_table(spark, "")
    assert not seen and not any(t.startswith("features_") for t in tables(spark) - kept)
    for names, most in (((), 2), (("NATR", "RSI"), 4), ("all", 43)):
        queries._model_table(spark, "", names)
        assert len([c for c in seen[-1] if c not in ("ticker", "date") and not c.startswith("_")]) <= most
    assert len([t for t in tables(spark) - kept if t.startswith("ranked_")]) == 1  # that of the model table, which still reads it


def test_lag_fits_on_a_narrow_table(spark, monkeypatch):
    """Same fits as on the wide table; the lags' table goes when the phase is done, and no fold is kept on disk."""
    x = make_panel(spark, {t: walk(300, i) for i, t in enumerate("ABCDE")}).selectExpr("ticker", "date", "close as f1", "high as f2", "close / open - 1 as y")
    folds = {"n_splits": 2, "train_days": 150, "test_days": 40, "purge_days": 5, "min_train": 10, "min_test": 10}
    run = lambda t: ML.run_phase(t, 1, "1900-01-01", "2999-12-31", ["f1", "f2"], ["y"], ("LagForecaster",), winsor=False, regime=False, **folds)
    kept = tables(spark)
    wide, narrow = run(x), run(x.select("ticker", "date", "y", F.lit(1).alias("_whole")))
    assert rows(wide[0]) == rows(narrow[0]) and rows(wide[1]) == rows(narrow[1]) and wide[0].count() == 2
    assert not any(t.startswith("lagged_") for t in tables(spark) - kept)
    assert not ML.FOLD_LEVEL.useDisk

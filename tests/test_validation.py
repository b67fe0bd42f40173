import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_helpers import make_panel, walk
from panelspark.functions.quantiles import exact_quantiles, grouped_quantiles
from panelspark.operators import validation as V


def test_fold_arithmetic(spark):
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(2499)]
    df = spark.createDataFrame([(t, x) for x in dates for t in ("A",)], "ticker string, date date")
    folds = V.purged_walk_forward(df, n_splits=8).orderBy("fold").collect()
    assert len(folds) == 5
    idx = {x: i for i, x in enumerate(dates)}
    f0 = folds[0]
    assert idx[f0["train_start"]] == 0 and idx[f0["train_end"]] == 1748 and idx[f0["test_start"]] == 1764
    assert f0["n_train"] == 1748 and f0["n_test"] == 126
    f1 = folds[1]
    assert idx[f1["train_start"]] == 111 and f1["n_train"] == 1763
    for f in folds:  # purge: 16 dates between the last training date and the test start
        assert idx[f["test_start"]] - (idx[f["train_end"]] - 1) - 1 == 16


def test_fold_assignment_disjoint(spark):
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(2000)]
    df = spark.createDataFrame([(t, x) for x in dates for t in ("A", "B")], "ticker string, date date")
    folds = V.purged_walk_forward(df, n_splits=3)
    a = V.assign_folds(df, folds)
    both = a.groupBy("fold", "ticker", "date").agg(F.countDistinct("split").alias("n")).filter("n > 1").count()
    assert both == 0


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [rnd.gauss(0, 1) for _ in range(20000)] + [0.5] * 3000 + [None] * 100
    ints = [float(rnd.randint(0, 7)) for _ in range(len(vals))]
    df = spark.createDataFrame(list(zip(vals, ints)), "a double, b double")
    probs = [0.0, 0.025, 0.1, 0.5, 0.9, 0.975, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    # a coarse sketch and few values to fetch: brackets that miss, and rounds of narrowing
    assert exact_quantiles(df, ["a", "b"], probs, accuracy=100, max_collect=30) == got
    a = np.array([v for v in vals if v is not None])
    assert got["a"] == pytest.approx(list(np.percentile(a, [p * 100 for p in probs])), rel=1e-12, abs=1e-12)
    assert got["b"] == pytest.approx(list(np.percentile(np.array(ints), [p * 100 for p in probs])))


def test_quantiles_of_all_groups_in_one_go(spark):
    rnd = random.Random(6)
    rows = [(g, rnd.choice([None, rnd.gauss(g or 0, 2), 1.25])) for g in (0, 1, 1, 1, 2, None) for _ in range(900)] + [(7, None), (8, 3.0)]
    df = spark.createDataFrame(rows, "fold int, v double")
    probs = [0.0, 0.025, 0.3, 0.975]
    for sizes in ({}, {"accuracy": 200, "max_collect": 10}):
        got = grouped_quantiles(df, ["v"], probs, by="fold", **sizes)
        for g in (0, 1, 2, None, 8):
            own = [v for f, v in rows if f == g and v is not None]
            assert got[g]["v"] == pytest.approx(list(np.percentile(own, [p * 100 for p in probs])), rel=1e-12)
        assert got[7]["v"] == [None] * 4
    assert exact_quantiles(df.limit(0), ["v"], probs) == {"v": [None] * 4}


def test_time_series_split_blocks(spark):
    rows = [(t, dt.date(2000, 1, 1) + dt.timedelta(days=i)) for i in range(25) for t in ("A", "B")]
    df = spark.createDataFrame(rows, "ticker string, date date")
    got = sorted((r["date"], r["ticker"], r["pos"], r["block"]) for r in V.time_series_split(df, 3).collect())
    n, ts = 50, 50 // 4
    for i, (_, _, pos, block) in enumerate(got):
        assert pos == i
        first = n - ts * 3
        assert block == (-1 if pos < first else (pos - first) // ts)


def test_winsorize_train_only(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(101)], "ret_1 double, other double")
    tr, te, b = V.winsorize(df, df, cols=["ret_1"])
    assert b["ret_1"] == pytest.approx((2.5, 97.5))
    assert tr.agg(F.max("ret_1")).first()[0] == pytest.approx(97.5)
    assert te.agg(F.max("ret_1")).first()[0] == 100.0


def test_condition_target_inverse(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "y double")
    x, p = V.condition_target(df, "y")
    assert not p["degenerate"]
    back = x.select((F.col("y_scaled") * p["std"] + p["mean"]).alias("b"), "y").collect()
    for r in back:
        assert p["lower"] - 1e-9 <= r["b"] <= p["upper"] + 1e-9


def test_folds_read_the_rows_once(spark, tmp_path):
    df = make_panel(spark, {t: walk(400, seed=i) for i, t in enumerate("AB")})
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    folds = V.purged_walk_forward(spark.read.parquet(path), n_splits=2, train_days=150, test_days=60, purge_days=5, min_train=10, min_test=10)
    assert folds.count() == 2
    assert folds._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_test_rows_look_back_through_the_purge_gap(spark):
    from panelspark.operators import models as ML
    df = make_panel(spark, {"A": [1.0 + i for i in range(80)]}).withColumn("fwd_ret_10", F.col("close") * 1.0)
    rows = ML.with_target_lags(df, "fwd_ret_10").orderBy("date").collect()
    # the first test row after a gap: its 10th lag is the row 10 back on the whole panel
    assert rows[66]["fwd_ret_10__lag10"] == rows[56]["close"]
    assert rows[66]["fwd_ret_10__lag14"] == rows[52]["close"]


def test_unlabelled_test_rows_are_predicted(spark):
    from panelspark.operators import models as ML
    rows = [("A", i, float(i % 7), float(i % 7) * 2 if i < 40 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, y double")
    m, pred, _ = ML.evaluate_fold("Linear", df.filter("date < 30"), df.filter("date >= 30"), ["x"], "y", min_train=5)
    got = pred.collect()
    assert len(got) == 20 and sum(r["actual"] is None for r in got) == 10 and m["test_size"] == 10
    assert abs(m["RMSE"]) < 1e-6


def test_quantiles_do_not_hang_on_the_spread_of_values(spark, monkeypatch):
    """Few passes also where one value is most of a column, or all values agree but for their last bits."""
    from panelspark.functions import quantiles as QU
    rnd = random.Random(7)
    near = [1.0 + rnd.randint(0, 10 ** 6) * 2 ** -52 for _ in range(4000)]
    rows = [(v, 0.25 if i % 10 else -rnd.random(), (-0.0, 0.0, float("nan"), -float("inf"))[i % 4]) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "near double, copies double, odd double").repartition(7)
    passes = []
    count = QU._cell_counts
    monkeypatch.setattr(QU, "_cell_counts", lambda *a: passes.append(a) or count(*a))
    probs = [0.0, 0.1, 0.5, 0.975]
    got = exact_quantiles(df, ["near", "copies"], probs, max_collect=10)
    for i, c in enumerate(("near", "copies")):
        assert got[c] == pytest.approx(list(np.percentile([r[i] for r in rows], [p * 100 for p in probs])), rel=1e-15)
    assert len(passes) <= 6
    assert exact_quantiles(df, ["odd"], [0.0, 0.5])["odd"] == [-float("inf"), 0.0]
    assert np.isnan(exact_quantiles(df, ["odd"], [1.0], persist=False)["odd"][0])


def test_passes_for_a_discrete_column_are_few(spark, monkeypatch):
    from panelspark.functions import quantiles as QU
    passes = []
    count = QU._cell_counts
    monkeypatch.setattr(QU, "_cell_counts", lambda *a: passes.append(a) or count(*a))
    df = spark.range(5000).selectExpr("cast(id % 7 as double) / 3 as v")
    got = exact_quantiles(df, ["v"], [0.3, 0.9], max_collect=5)["v"]
    assert got == pytest.approx(list(np.percentile([i % 7 / 3 for i in range(5000)], [30, 90]))) and len(passes) <= 3


def test_quantile_tasks_travel_without_the_package(tmp_path):
    """A worker that cannot import this package must be able to load and run what is sent to it."""
    import subprocess
    import sys
    from pyspark import cloudpickle
    from panelspark.functions import quantiles as QU
    (tmp_path / "f").write_bytes(cloudpickle.dumps([QU._cell_counts(False, None, 53, 11), QU._cell_values(False, {(None, 0): np.array([0])}, 64 - 1)]))
    code = ("import pickle, sys, pyarrow as pa; fs = pickle.load(open('f', 'rb')); b = pa.record_batch([pa.array([1.0, None, -2.0])], names=['v']);"
            "print(sum(sum(x.column(3).to_pylist()) for x in fs[0]([b])), sum(x.num_rows for x in fs[1]([b])), 'panelspark' in sys.modules)")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert got.stdout.split() == ["2", "1", "False"], got.stderr

import pytest

from panelspark.operators import metrics as M
from panelspark.operators import roles as RL

NAMES = ["ticker", "date", "fwd_vola_05", "ret_1", "fwd_log_ret_05", "fwd_log_ret_10", "dl_label_05", "RSI"]


def test_roles():
    t, f = RL.infer_roles(NAMES)
    assert t == ["fwd_vola_05", "fwd_log_ret_05", "fwd_log_ret_10", "dl_label_05"] and f == ["ret_1", "RSI"]


def test_eda_and_slice():
    assert RL.eda_features(NAMES) == ["ret_1", "RSI"]
    assert RL.first_n(["a", "b", "c"], 2) == ["a", "b"]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, None), (3.0, 1.0, None), (4.0, None, 2.0)],
                               "a double, b double, c double")
    out, dropped = RL.drop_sparse_columns(df, ["a", "b", "c"])  # keep >= int(0.5 * 4) = 2 values
    assert dropped == ["b"]
    assert "a" in out.columns


def test_sharpe_zero_std(spark):
    df = spark.createDataFrame([(1, "m", "t", 1, 0.01, 1.0)] * 5,
                               "phase int, model string, target string, fold int, actual double, pred double")
    r = M.fold_metrics(df).first()
    assert r["Sharpe"] == 0.0 and r["RMSE"] == pytest.approx(0.99)


def test_sharpe_value(spark):
    ys = [0.01, -0.02, 0.03, 0.01]
    ps = [1.0, -1.0, 1.0, -1.0]
    df = spark.createDataFrame([(1, "m", "t", 0, y, p) for y, p in zip(ys, ps)],
                               "phase int, model string, target string, fold int, actual double, pred double")
    import statistics
    pnl = [y * (1 if p > 0 else -1) for y, p in zip(ys, ps)]
    exp = statistics.mean(pnl) / statistics.stdev(pnl) * 252 ** 0.5
    assert M.fold_metrics(df).first()["Sharpe"] == pytest.approx(exp)


def test_best_model_and_overall_score(spark):
    stats = spark.createDataFrame(
        [(1, "a", "t", 0, 1.0, 1.0, 0.5), (1, "b", "t", 0, 2.0, 2.0, 0.9), (1, "b", "t", 1, 2.0, 2.0, -1.0)],
        "phase int, model string, target string, fold int, RMSE double, MAE double, Sharpe double")
    best = M.best_model(stats).first()
    assert best["best_model"] == "b" and best["best_sharpe"] == 0.9
    summ = M.fold_summary(stats)
    sc = {r["model"]: r["Overall_Score"] for r in M.overall_score(summ).collect()}
    assert sc["a"] == pytest.approx(1.0) and sc["b"] == pytest.approx(0.0)  # a better on all three

"""Evaluation metrics and comparison reports (A-16 ... A-25, A-30, A-31, T-07, T-08, U-01, F-16).

Input is the long out-of-sample store ``phase, fold, model, target, ticker,
date, actual, pred`` (one row per prediction) and the fit log ``phase, fold,
model, target, seconds``. Metrics are one grouped aggregate over the store
(partial aggregation per group key, no per-fold driver loop); every report
after that works on a few rows per (phase, model, target, fold).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import safe_div

PERIODS_PER_YEAR = 252
METRICS = ("RMSE", "MAE", "Sharpe")


def round_half_even(x, digits: int) -> Column:
    """pandas/NumPy ``round``: half-to-even on the binary value."""
    s = float(10 ** digits)
    return F.rint(x * F.lit(s)) / F.lit(s)


# ---------------------------------------------------------------- A-16, A-17
def sharpe_expr(actual="actual", pred="pred", periods: int = PERIODS_PER_YEAR) -> Column:
    """mean/std (sample) of pnl = sign(pred) * actual, times sqrt(periods); 0 when std is 0 or undefined."""
    pnl = F.signum(F.col(pred)) * F.col(actual)
    sd = F.stddev_samp(pnl)
    return F.when(sd > 0, F.avg(pnl) / sd * F.lit(math.sqrt(periods))).otherwise(F.lit(0.0))


def fold_metrics(preds: DataFrame, by=("phase", "model", "target", "fold"), periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """RMSE, MAE, Sharpe and row count per group (one pass over the store)."""
    err = F.col("actual") - F.col("pred")
    return preds.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("RMSE"), F.avg(F.abs(err)).alias("MAE"),
        sharpe_expr(periods=periods).alias("Sharpe"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- A-18, A-19
def fold_summary(stats: DataFrame, by=("model", "target"), digits: int = 4) -> DataFrame:
    """mean / std / min / max of each metric over folds, rounded like pandas."""
    aggs = []
    for m in METRICS:
        for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            aggs.append(round_half_even(fn(m), digits).alias(f"{m}_{name}"))
    return stats.groupBy(*by).agg(*aggs)


def phase_comparison(stats: DataFrame, digits: int = 4) -> DataFrame:
    """By phase, model, target: RMSE and MAE mean/std/min, Sharpe mean/std/max."""
    spec = {"RMSE": ("mean", "std", "min"), "MAE": ("mean", "std", "min"), "Sharpe": ("mean", "std", "max")}
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = [round_half_even(fns[s](m), digits).alias(f"{m}_{s}") for m, ss in spec.items() for s in ss]
    return stats.groupBy("phase", "model", "target").agg(*aggs)


# ---------------------------------------------------------------- A-20
def pivot_metric(summary: DataFrame, index: str, columns: str, values: str, levels: list) -> DataFrame:
    """``pivot_table(aggfunc="mean")`` with an explicit list of column levels
    (no extra pass to discover them)."""
    return summary.groupBy(index).pivot(columns, levels).agg(F.avg(values))


# ---------------------------------------------------------------- A-21
def overall_score(summary: DataFrame, by=("model",), within=(), digits: int | None = 4) -> DataFrame:
    """Per model mean of Sharpe_mean, RMSE_mean, MAE_mean (rounded), min-max
    normalised across models (Sharpe upward; RMSE and MAE inverted), averaged.
    ``within`` = ("phase",) normalises inside each phase. A single model has
    no spread: its normalised values are NULL."""
    keys = list(within) + list(by)
    agg = summary.groupBy(*keys).agg(*[F.avg(f"{m}_mean").alias(f"{m}_mean") for m in METRICS])
    if digits is not None:
        agg = agg.select(*keys, *[round_half_even(F.col(f"{m}_mean"), digits).alias(f"{m}_mean") for m in METRICS])
    w = Window.partitionBy(*within) if within else Window.partitionBy()

    def norm(c, invert):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        z = safe_div(F.col(c) - lo, hi - lo)
        return (F.lit(1.0) - z) if invert else z

    x = agg.select(*keys, *[f"{m}_mean" for m in METRICS],
                   norm("Sharpe_mean", False).alias("Sharpe_norm"), norm("RMSE_mean", True).alias("RMSE_norm"),
                   norm("MAE_mean", True).alias("MAE_norm"))
    return x.withColumn("Overall_Score", (F.col("Sharpe_norm") + F.col("RMSE_norm") + F.col("MAE_norm")) / 3)


# ---------------------------------------------------------------- A-22, A-23, A-25
def timing_summary(timing: DataFrame, digits: int = 2) -> DataFrame:
    s = F.col("seconds")
    return timing.groupBy("model").agg(
        round_half_even(F.avg(s), digits).alias("seconds_mean"), round_half_even(F.stddev_samp(s), digits).alias("seconds_std"),
        round_half_even(F.min(s), digits).alias("seconds_min"), round_half_even(F.max(s), digits).alias("seconds_max"),
        F.count(s).alias("seconds_count"), round_half_even(F.sum(s), digits).alias("seconds_sum"))


def time_by_target(timing: DataFrame) -> DataFrame:
    return timing.groupBy("model", "target").agg(F.avg("seconds").alias("seconds_mean"))


def box_summary(timing: DataFrame) -> DataFrame:
    """Quartiles of fit seconds per model (one row per fit: a bounded group)."""
    q = F.percentile("seconds", [0.0, 0.25, 0.5, 0.75, 1.0])
    return timing.groupBy("model").agg(q.alias("_q")).select(
        "model", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q0", "q25", "q50", "q75", "q100"))])


# ---------------------------------------------------------------- A-30, A-31
def run_overview(stats: DataFrame) -> DataFrame:
    return stats.agg(F.countDistinct("model").alias("n_models"), F.countDistinct("phase").alias("n_phases"),
                     F.countDistinct("target").alias("n_targets"),
                     F.array_sort(F.collect_set("phase")).alias("phases"))


def efficiency(summary: DataFrame, timing: DataFrame) -> DataFrame:
    """Mean Sharpe / mean seconds per model (J-12 join on model), descending."""
    perf = summary.groupBy("model").agg(F.avg("Sharpe_mean").alias("Sharpe_mean"))
    t = timing.groupBy("model").agg(F.avg("seconds").alias("seconds_mean"))
    return perf.join(t, "model", "inner").withColumn(
        "efficiency", safe_div(F.col("Sharpe_mean"), F.col("seconds_mean"))) \
        .orderBy(F.col("efficiency").desc_nulls_last(), "model")


# ---------------------------------------------------------------- T-07, T-08
def best_model(stats: DataFrame, by: str = "max_fold") -> DataFrame:
    """Per phase and target the model with the highest Sharpe: of a single
    fold (as run) or of the fold mean (``by="mean"``). Ties -> first model
    name in ascending order."""
    if by == "mean":
        stats = stats.groupBy("phase", "target", "model").agg(F.avg("Sharpe").alias("Sharpe"))
    ranked = stats.withColumn("_r", F.dense_rank().over(Window.partitionBy("phase", "target").orderBy("model")))
    key = F.struct(F.col("Sharpe"), F.lit(0) - F.col("_r"))
    return ranked.groupBy("phase", "target").agg(F.max_by(F.struct("model", "Sharpe"), key).alias("b")) \
        .select("phase", "target", F.col("b.model").alias("best_model"), F.col("b.Sharpe").alias("best_sharpe"))


def extremes(perf: DataFrame, value: str, label: str = "model") -> DataFrame:
    """Arg-max and arg-min of ``value`` (ties -> smallest label)."""
    x = perf.withColumn("_r", F.dense_rank().over(Window.orderBy(label)))
    hi = F.struct(F.col(value), F.lit(0) - F.col("_r"))
    lo = F.struct(F.lit(0) - F.col(value), F.lit(0) - F.col("_r"))
    x = x.select(label, value, hi.alias("_hi"), lo.alias("_lo"))
    return x.agg(F.max_by(label, "_hi").alias(f"max_{label}"), F.max(value).alias(f"max_{value}"),
                 F.max_by(label, "_lo").alias(f"min_{label}"), F.min(value).alias(f"min_{value}"))


# ---------------------------------------------------------------- U-01, F-16
def union_results(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def models_in(df: DataFrame, models, col: str = "model") -> DataFrame:
    return df.filter(F.col(col).isin(list(models)))
